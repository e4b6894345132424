"""Sinks and model weight tables."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

WEIGHTS_SCHEMA = T.StructType([
    T.StructField("layer", T.StringType(), False),
    T.StructField("row", T.IntegerType(), False),
    T.StructField("coef", T.ArrayType(T.DoubleType()), False),
    T.StructField("intercept", T.DoubleType(), True),
])

# Output column names and status texts of the reference's scored file.
REFERENCE_SCORE_COL = "预测分数"
REFERENCE_STATUS_COL = "处理状态"
REFERENCE_SUCCESS = "成功"
REFERENCE_SKIPPED = "跳过(空文本)"
REFERENCE_FAILED_PREFIX = "失败: "

# Heads larger than this many doubles (~256 MiB) are not broadcast; the driver loads up to 16 times as many.
MAX_HEAD_VALUES = 32 * 1024 * 1024
MAX_LOADED_VALUES = 16 * MAX_HEAD_VALUES


def write_scored(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                 partition_by: list[str] | None = None, order_col: str | None = None) -> None:
    """Write a scored table.

    ``order_col`` restores input order (F4) with a global sort: Spark samples the
    column, range-partitions and sorts each range, so file ``part-00000`` holds the
    first rows and the work stays spread over all tasks.  Without it nothing is
    reordered.
    """
    out = df.orderBy(order_col) if order_col else df
    w = out.write.mode(mode).format(fmt)
    if fmt == "csv":
        w = w.option("header", "true").option("escape", '"')
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def to_reference_layout(scored: DataFrame) -> DataFrame:
    """Scored table in the reference's layout: input columns + score + status text.

    ``failed`` rows carry the error message after the failure prefix, as the
    reference writes them; ``error`` is folded into the status column.
    """
    status = (F.when(F.col("status") == "success", F.lit(REFERENCE_SUCCESS))
               .when(F.col("status") == "skipped", F.lit(REFERENCE_SKIPPED))
               .otherwise(F.concat(F.lit(REFERENCE_FAILED_PREFIX), F.coalesce(F.col("error"), F.lit("")))))
    keep = [c for c in scored.columns if c not in ("pred_score", "status", "error")]
    return scored.select(*keep, F.col("pred_score").alias(REFERENCE_SCORE_COL), status.alias(REFERENCE_STATUS_COL))


def from_reference_layout(table: DataFrame) -> DataFrame:
    """A scored file in the reference's layout with the library's ``pred_score``, ``status`` and ``error`` columns."""
    text = F.col(REFERENCE_STATUS_COL)
    status = (F.when(text == REFERENCE_SUCCESS, "success").when(text == REFERENCE_SKIPPED, "skipped")
               .when(text.startswith(REFERENCE_FAILED_PREFIX), "failed"))
    error = F.when(text.startswith(REFERENCE_FAILED_PREFIX), F.expr(f"substring(`{REFERENCE_STATUS_COL}`, {len(REFERENCE_FAILED_PREFIX) + 1})"))
    keep = [c for c in table.columns if c not in (REFERENCE_SCORE_COL, REFERENCE_STATUS_COL)]
    return table.select(*keep, F.col(REFERENCE_SCORE_COL).cast("double").alias("pred_score"), status.alias("status"), error.alias("error"))


def write_metrics_json(metrics: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Long-form metrics ``(group..., metric, value)`` as JSON lines."""
    metrics.write.mode(mode).json(path)


@dataclass
class OrdinalHead:
    """Weights of an ordinal head.

    ``blocks`` is a list of residual blocks ``(ln_gamma, ln_beta, W, b, P, p)`` with
    ``P``/``p`` None when the block keeps its width (identity projection);
    ``coef``/``intercept`` is the final K-1 threshold layer.
    """
    coef: np.ndarray                      # (K-1, D_last)
    intercept: np.ndarray                 # (K-1,)
    score_points: list[float]
    blocks: list[tuple] | None = None

    @property
    def n_thresholds(self) -> int:
        return int(self.coef.shape[0])

    @property
    def in_dim(self) -> int:
        if self.blocks:
            return int(self.blocks[0][2].shape[1])
        return int(self.coef.shape[1])

    def n_values(self) -> int:
        n = self.coef.size + self.intercept.size
        for blk in self.blocks or []:
            n += sum(np.asarray(a).size for a in blk if a is not None)
        return n


def _rows(layer: str, mat: np.ndarray, bias: np.ndarray | None):
    mat = np.atleast_2d(np.asarray(mat, dtype=float))
    for i, r in enumerate(mat):
        yield (layer, i, [float(v) for v in r], None if bias is None else float(bias[i]))


def save_head(spark: SparkSession, head: OrdinalHead, path: str, mode: str = "overwrite") -> None:
    """Write weights and score points as two Parquet tables under ``path``."""
    rows = list(_rows("out", head.coef, head.intercept))
    for i, (g, be, w, b, p, pb) in enumerate(head.blocks or []):
        rows += list(_rows(f"b{i}.ln", np.vstack([g, be]), None))
        rows += list(_rows(f"b{i}.fc", w, b))
        if p is not None:
            rows += list(_rows(f"b{i}.proj", p, pb))
    spark.createDataFrame(rows, WEIGHTS_SCHEMA).coalesce(1).write.mode(mode).parquet(f"{path}/weights")
    pts = [(i, float(v)) for i, v in enumerate(head.score_points)]
    (spark.createDataFrame(pts, "label_idx int, label double").coalesce(1)
          .write.mode(mode).parquet(f"{path}/score_points"))


def load_head(spark: SparkSession, path: str) -> OrdinalHead:
    """Read a head written by :func:`save_head`.

    The weight table has one row per output unit, so it is bounded by the head's
    size; it is checked against ``MAX_LOADED_VALUES`` before being collected.
    """
    w = spark.read.parquet(f"{path}/weights")
    n_values = w.select(F.sum(F.size("coef") + 1).alias("n")).first()["n"] or 0
    if n_values > MAX_LOADED_VALUES:
        raise ValueError(f"head has {n_values} values; above the driver's limit {MAX_LOADED_VALUES}")
    rows = w.collect()
    by_layer: dict[str, list] = {}
    for r in rows:
        by_layer.setdefault(r["layer"], []).append(r)

    def mat(layer):
        rs = sorted(by_layer[layer], key=lambda r: r["row"])
        m = np.array([r["coef"] for r in rs], dtype=float)
        b = np.array([r["intercept"] if r["intercept"] is not None else 0.0 for r in rs])
        return m, b

    coef, intercept = mat("out")
    blocks = []
    i = 0
    while f"b{i}.fc" in by_layer:
        ln, _ = mat(f"b{i}.ln")
        fw, fb = mat(f"b{i}.fc")
        if f"b{i}.proj" in by_layer:
            pw, pb = mat(f"b{i}.proj")
        else:
            pw, pb = None, None
        blocks.append((ln[0], ln[1], fw, fb, pw, pb))
        i += 1
    pts = [r["label"] for r in spark.read.parquet(f"{path}/score_points").orderBy("label_idx").collect()]
    return OrdinalHead(coef=coef, intercept=intercept, score_points=pts, blocks=blocks or None)
