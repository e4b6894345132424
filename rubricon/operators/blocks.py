"""Heads too large to broadcast: blockwise matrix products.

Vectors are packed into panels of rows, weights into square blocks.  A layer sends the column pieces of every panel to the weight
blocks of the same columns, multiplies them there and adds the partial products up by panel.  Nobody holds a whole weight matrix
but the driver, which hands it out block by block; a task holds one piece and one block at a time, and at
the end of a layer one panel.  The blocks of a column are copied ``SALTS`` times, so the few block columns do not bound the parallelism.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rubricon.session import checkpoint_dir, join_keys
from rubricon.sources.sinks import OrdinalHead

PANEL = 512                 # rows of a panel
SIDE = 1_024                # rows and columns of a weight block
SALTS = 16

PANEL_SCHEMA = "panel long, ids binary, x binary"


def _f8(data: bytes, width: int) -> np.ndarray:
    return np.frombuffer(data, "<f8").reshape(-1, width)


def _weight_blocks(spark, matrices: dict[str, np.ndarray]) -> DataFrame:
    """``(kind, j, o, w, salt)``: the blocks of each matrix, column block ``j`` and row block ``o``."""
    rows = [(kind, j // SIDE, o // SIDE, np.ascontiguousarray(m[o:o + SIDE, j:j + SIDE], "<f8").tobytes())
            for kind, m in matrices.items() for j in range(0, m.shape[1], SIDE) for o in range(0, m.shape[0], SIDE)]
    schema = T.StructType([T.StructField("kind", T.StringType()), T.StructField("j", T.IntegerType()), T.StructField("o", T.IntegerType()),
                           T.StructField("w", T.BinaryType())])
    return spark.createDataFrame(rows, schema).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _products(panels: DataFrame, width: int, matrices: dict[str, np.ndarray], prepare) -> DataFrame:
    """``(panel, kind, o, part)``: the products of each panel's pieces with the blocks of every matrix, not yet added up over the columns.
    ``prepare(x)`` gives the left factor of each kind."""
    kinds = list(matrices)

    def split(batches):
        import pyarrow as pa

        for b in batches:
            for panel, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                factors = prepare(_f8(data, width))
                for kind in kinds:
                    for j in range(0, width, SIDE):
                        piece = np.ascontiguousarray(factors[kind][:, j:j + SIDE])
                        yield pa.RecordBatch.from_arrays([pa.array([panel]), pa.array([kind]), pa.array([j // SIDE], pa.int32()), pa.array([piece.tobytes()], pa.binary())],
                                                         names=["panel", "kind", "j", "piece"])

    def multiply(batches):
        import pyarrow as pa

        for b in batches:
            for i in range(b.num_rows):
                j, o = b.column(2)[i].as_py(), b.column(3)[i].as_py()
                cols = min(SIDE, width - j * SIDE)
                part = _f8(b.column(4)[i].as_py(), cols) @ _f8(b.column(5)[i].as_py(), cols).T
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), b.column(1).slice(i, 1), pa.array([o], pa.int32()), pa.array([part.tobytes()], pa.binary())],
                                                 names=["panel", "kind", "o", "part"])

    pieces = panels.select("panel", "x").mapInArrow(split, "panel long, kind string, j int, piece binary")
    pieces = pieces.withColumn("salt", F.pmod(F.xxhash64("panel"), F.lit(SALTS)).cast("int"))
    met = pieces.join(_weight_blocks(panels.sparkSession, matrices), ["kind", "j", "salt"])
    return met.select("panel", "kind", "j", "o", "piece", "w").mapInArrow(multiply, "panel long, kind string, o int, part binary")


def _layer(panels: DataFrame, width: int, matrices: dict[str, np.ndarray], prepare, finish) -> DataFrame:
    """Panels after a layer: ``finish(x, sums)`` gives the new rows from the old ones and each kind's product."""
    heights = {kind: len(m) for kind, m in matrices.items()}

    def close(own, parts):
        import pandas as pd

        x = _f8(own["x"].iloc[0], width)
        sums = {}
        for kind, height in heights.items():
            total = np.zeros((len(x), height))
            for o, group in parts[parts["kind"] == kind].groupby("o"):
                cols = slice(o * SIDE, min((o + 1) * SIDE, height))
                for part in group["part"]:
                    total[:, cols] += _f8(part, cols.stop - cols.start)
            sums[kind] = total
        return pd.DataFrame({"panel": own["panel"], "ids": own["ids"], "x": [np.ascontiguousarray(finish(x, sums), "<f8").tobytes()]})

    products = _products(panels, width, matrices, prepare)
    return panels.groupBy("panel").cogroup(products.groupBy("panel")).applyInPandas(close, PANEL_SCHEMA).checkpoint(eager=True)


def blocked_logits(df: DataFrame, head: OrdinalHead, x: str, out: str) -> DataFrame:
    """Adds the logits of ``head`` applied to the list column ``x``, which is dropped; same results as the broadcast path.

    The rows are checkpointed once under a row number, by which their logits return to them.
    """
    from rubricon.operators.ordinal import gelu, layer_norm

    spark = df.sparkSession
    checkpoint_dir(spark)
    dim = head.in_dim
    rows = df.withColumn("_row", F.monotonically_increasing_id()).checkpoint(eager=True)
    whole = F.col(x).isNotNull() & ~F.exists(x, lambda v: v.isNull())
    wrong = F.raise_error(F.lit(f"vector length differs from the head input size {dim}")).cast("array<double>")
    sound = rows.filter(F.col(x).isNotNull()).select("_row", F.when(F.size(x) != dim, wrong).otherwise(F.col(x)).alias("_v"), whole.alias("_ok")).filter(
        F.col("_ok") & F.col("_v").isNotNull()).select("_row", "_v")

    def pack(batches):
        import pyarrow as pa

        for b in batches:
            ids, v = b.column(0).to_numpy().astype("<i8"), b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            for i in range(0, len(ids), PANEL):
                yield pa.RecordBatch.from_arrays([pa.array([int(ids[i])]), pa.array([ids[i:i + PANEL].tobytes()], pa.binary()),
                                                  pa.array([np.ascontiguousarray(v[i:i + PANEL], "<f8").tobytes()], pa.binary())], names=["panel", "ids", "x"])

    panels = sound.mapInArrow(pack, PANEL_SCHEMA).checkpoint(eager=True)
    width = dim
    for gamma, beta, w, b, pw, pb in head.blocks or []:
        gamma, beta, b = (np.asarray(a, float) for a in (gamma, beta, b))
        matrices = {"w": np.asarray(w, float)} | ({} if pw is None else {"p": np.asarray(pw, float)})
        shift = 0.0 if pb is None else np.asarray(pb, float)

        def prepare(h, gamma=gamma, beta=beta):
            return {"w": layer_norm(h, gamma, beta), "p": h}

        def finish(h, sums, b=b, shift=shift):
            return gelu(sums["w"] + b) + (sums["p"] + shift if "p" in sums else h)

        panels = _layer(panels, width, matrices, prepare, finish)
        width = matrices["w"].shape[0]
    intercept, k_out = np.asarray(head.intercept, float), head.n_thresholds
    panels = _layer(panels, width, {"c": np.asarray(head.coef, float)}, lambda h: {"c": h}, lambda h, sums: sums["c"] + intercept)

    def unpack(batches):
        import pyarrow as pa

        for b in batches:
            for ids, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                logits = _f8(data, k_out)
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(ids, "<i8")), pa.array(logits.tolist(), pa.list_(pa.float64()))], names=["_row", out])

    found = panels.select("ids", "x").mapInArrow(unpack, f"_row long, `{out}` array<double>")
    return join_keys(rows.drop(x), found, ["_row"], "left").drop("_row")
