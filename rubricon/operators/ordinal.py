"""Ordinal head: logits, probabilities, decode, loss, fitting, validation.

Heads of every size run as numpy matrix products over Arrow record batches
(``mapInArrow``) with the weights shipped once per executor as a broadcast
variable whose size is checked first.  ``method="expr"`` writes a linear head as a
column expression with the same results, for callers that ask for it.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rubricon.functions.ordinal import (
    bce_with_logits_sum, decode_scores, linear_logits, sigmoid_array,
)
from rubricon.operators import agree
from rubricon.sources.sinks import MAX_HEAD_VALUES, OrdinalHead

LAYER_NORM_EPS = 1e-5


# ------------------------------------------------------------------ numpy kernels

_ERF_STEP = 1e-3
_ERF_MAX = 6.0              # erf(6) = 1 - 2e-17: exactly 1 in double precision
_ERF_GRID = np.array([math.erf(i * _ERF_STEP) for i in range(int(_ERF_MAX / _ERF_STEP) + 2)])
_ERF_SLOPE = (2.0 / math.sqrt(math.pi)) * np.exp(-(np.arange(_ERF_GRID.size) * _ERF_STEP) ** 2) * _ERF_STEP


def erf(x: np.ndarray) -> np.ndarray:
    """Vectorised error function, absolute error below 1e-13.

    Cubic Hermite interpolation on a 0.001 grid of exact values and exact
    derivatives (2/sqrt(pi) exp(-x^2)); beyond |x| = 6 the value is +/-1.
    """
    x = np.asarray(x, dtype=float)
    a = np.minimum(np.abs(x), _ERF_MAX)
    u = a / _ERF_STEP
    i = np.minimum(np.nan_to_num(u).astype(np.int64), _ERF_GRID.size - 2)       # NaN stays NaN through t
    t = u - i
    t2 = t * t
    t3 = t2 * t
    val = ((2 * t3 - 3 * t2 + 1) * _ERF_GRID[i] + (t3 - 2 * t2 + t) * _ERF_SLOPE[i]
           + (3 * t2 - 2 * t3) * _ERF_GRID[i + 1] + (t3 - t2) * _ERF_SLOPE[i + 1])
    return np.sign(x) * val


def gelu(x: np.ndarray) -> np.ndarray:
    """Exact GELU ``x * Phi(x)`` with the error function."""
    x = np.asarray(x, dtype=float)
    return 0.5 * x * (1.0 + erf(x / math.sqrt(2.0)))


def layer_norm(x: np.ndarray, gamma: np.ndarray, beta: np.ndarray, eps: float = LAYER_NORM_EPS) -> np.ndarray:
    """LayerNorm over the last axis with population variance."""
    mu = x.mean(axis=-1, keepdims=True)
    var = ((x - mu) ** 2).mean(axis=-1, keepdims=True)
    return (x - mu) / np.sqrt(var + eps) * gamma + beta


def head_forward(x: np.ndarray, head: OrdinalHead) -> np.ndarray:
    """Forward pass: per block ``GELU(Linear(LayerNorm(x))) + proj(x)``, then the K-1 layer.

    Dropout is the identity at scoring time.
    """
    h = np.asarray(x, dtype=float)
    for gamma, beta, w, b, pw, pb in head.blocks or []:
        residual = h if pw is None else h @ np.asarray(pw).T + pb
        h = gelu(layer_norm(h, gamma, beta) @ np.asarray(w).T + b) + residual
    return h @ head.coef.T + head.intercept


def decode_numpy(probs: np.ndarray, score_points, tie_eps: float = 1e-9) -> np.ndarray:
    """Numpy twin of :func:`rubricon.functions.ordinal.decode_scores` for in-task scoring.

    Prefix distances d_0 = sum(p), d_{k+1} = d_k + 1 - 2 p_k; a later index must be better
    than the best so far by more than ``tie_eps``; a row containing NaN decodes to the
    first point.
    """
    p = np.atleast_2d(np.asarray(probs, dtype=float))
    dist = p.sum(axis=1)
    best, idx = dist.copy(), np.zeros(len(p), np.int64)
    for k in range(p.shape[1]):
        dist = dist + 1.0 - 2.0 * p[:, k]
        better = dist < best - tie_eps
        best[better], idx[better] = dist[better], k + 1
    idx[np.isnan(p).any(axis=1)] = 0
    return np.asarray(score_points, dtype=float)[idx]


# ------------------------------------------------------------------ logits

def _features(df: DataFrame, vec: str, features: str | None) -> F.Column:
    v = F.col(vec).cast("array<double>")
    if features is None:
        return v
    return F.concat(v, F.col(features).cast("array<double>"))     # H9


def _check_size(head: OrdinalHead) -> None:
    if head.n_values() > MAX_HEAD_VALUES:
        raise ValueError(f"head has {head.n_values()} values; above the broadcast limit {MAX_HEAD_VALUES}")


def head_logits(df: DataFrame, head: OrdinalHead, vec: str = "pooled", features: str | None = None,
                out: str = "logits", method: str = "numpy") -> DataFrame:
    """Add the K-1 logits of ``head`` applied to ``vec`` (optionally ``concat(vec, features)``).

    A head of more than ``MAX_HEAD_VALUES`` values is not broadcast but multiplied block by block
    (:mod:`rubricon.operators.blocks`).  ``method``: ``"numpy"`` (Arrow record batches) or ``"expr"`` (JVM expression, linear
    heads only).  In both a null vector, or one with a null element, has null logits, and a
    vector of another length than the head's input fails the job.
    """
    x = _features(df, vec, features)
    if method in ("expr", "numpy") and head.n_values() > MAX_HEAD_VALUES:
        from rubricon.operators.blocks import blocked_logits
        return blocked_logits(df.withColumn("_x", x), head, "_x", out)
    if method == "expr":
        if head.blocks:
            raise ValueError("expression form covers linear heads only")
        return df.withColumn(out, linear_logits(x, head.coef.tolist(), head.intercept.tolist()))
    if method != "numpy":
        raise ValueError(f"unknown method {method!r}")
    return _numpy_logits(df.withColumn("_x", x), head, out)


def _numpy_logits(df: DataFrame, head: OrdinalHead, out: str) -> DataFrame:
    """Head forward pass over Arrow record batches (``mapInArrow``).

    The ``_x`` list column is viewed as one (rows, D) matrix straight from the
    Arrow buffers — no per-row Python — multiplied in numpy, and the logits are
    returned as a list column built from the flat result.  Null vectors and vectors
    with a null element give null logits.  Weights arrive once per executor as a broadcast variable.
    """
    from rubricon.session import ship_package

    spark = df.sparkSession
    ship_package(spark)
    bc = spark.sparkContext.broadcast(head)
    keep = [c for c in df.columns if c != "_x"]
    schema = T.StructType([f for f in df.schema.fields if f.name != "_x"]
                          + [T.StructField(out, T.ArrayType(T.DoubleType()))])
    k_out = head.n_thresholds
    dim = head.in_dim

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        h = bc.value
        for rb in batches:
            n = rb.num_rows
            col = rb.column(rb.schema.get_field_index("_x"))
            valid = col.is_valid().to_numpy(zero_copy_only=False)
            lengths = pc.list_value_length(col).to_numpy(zero_copy_only=False)
            if np.any(valid & (lengths != dim)):
                raise ValueError(f"vector length differs from the head input size {dim}")
            mat = np.zeros((n, dim))
            if valid.any():
                flat = col.filter(pa.array(valid)).flatten()
                mat[valid] = flat.to_numpy(zero_copy_only=False).reshape(-1, dim)
                if flat.null_count:
                    holes = flat.is_null().to_numpy(zero_copy_only=False).reshape(-1, dim).any(axis=1)
                    valid[np.flatnonzero(valid)[holes]] = False
                    mat[~valid] = 0.0
            logits = head_forward(mat, h)
            offsets = pa.array(np.arange(0, (n + 1) * k_out, k_out, dtype=np.int32))
            arr = pa.ListArray.from_arrays(offsets, pa.array(logits.ravel()), mask=pa.array(~valid))
            cols = [rb.column(rb.schema.get_field_index(c)) for c in keep] + [arr]
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, out])

    return df.mapInArrow(run, schema)


def linear_head(df, head: OrdinalHead, vec="pooled", features=None, out="logits", method="numpy"):
    """Linear ordinal head D -> K-1."""
    if head.blocks:
        raise ValueError("linear_head expects a head without hidden blocks")
    return head_logits(df, head, vec, features, out, method)


def deep_head(df, head: OrdinalHead, vec="pooled", features=None, out="logits"):
    """Residual MLP head forward pass (I6); always the numpy path."""
    return head_logits(df, head, vec, features, out, "numpy")


# ------------------------------------------------------------------ probabilities, decode, loss

def probabilities(df: DataFrame, logits: str = "logits", out: str = "probs") -> DataFrame:
    return df.withColumn(out, sigmoid_array(logits))


def decode(df: DataFrame, score_points: Sequence[float] | str, probs: str = "probs",
           out: str = "score") -> DataFrame:
    """Score point whose threshold pattern is nearest in L1 (I3); ties go to the lowest."""
    return df.withColumn(out, decode_scores(probs, score_points))


def ordinal_loss(df: DataFrame, logits: str = "logits", label_idx: str = "label_idx",
                 group_cols: Sequence[str] = ()) -> DataFrame:
    """Mean binary cross-entropy over every (row, threshold).

    Output ``(group..., loss, n_rows, n_terms)``; rows contribute their whole
    threshold vector, so the mean is ``sum of row sums / sum of sizes``.  Rows without
    a label or without logits have no loss and are not counted.
    """
    known = df.filter(F.col(label_idx).isNotNull() & F.col(logits).isNotNull())
    return (known.groupBy(*group_cols).agg(
        F.sum(bce_with_logits_sum(logits, label_idx)).alias("_s"),
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(F.size(logits)).alias("n_terms"))
        .select(*group_cols, F.try_divide(F.col("_s"), F.col("n_terms").cast("double")).alias("loss"),
                "n_rows", F.col("n_terms").cast("long").alias("n_terms")))


def validate(df: DataFrame, score_points: Sequence[float], logits: str = "logits",
             label_idx: str = "label_idx", label: str = "label", tolerance: float = 0.0,
             group_cols: Sequence[str] = ()) -> DataFrame:
    """Validation summary (D14): metric bundle of decoded scores vs labels plus ``val_loss``.

    One pass over the facts: the contingency cells carry the summed row losses
    and threshold counts, the cell table is checkpointed once, and both the
    metrics and ``val_loss`` (row-weighted, as the reference's) are read from it —
    so an expensive upstream (a deep head, a model) runs once.  The tolerance
    pair is reported only when ``tolerance > 0``.
    """
    from rubricon.session import materialize_small

    g = list(group_cols)
    tol = tolerance if tolerance and tolerance > 0 else None
    df = df.filter(F.col(label).isNotNull() & F.col(label_idx).isNotNull())     # unlabelled rows have no loss
    scored = decode(probabilities(df, logits), score_points)
    cells = scored.groupBy(*g, F.col("score").cast("double").alias("pred"),
                           F.col(label).cast("double").alias("label")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(bce_with_logits_sum(logits, label_idx)).alias("_loss"),
        F.sum(F.size(logits)).alias("_terms"))
    cells, n_cells = materialize_small(cells)
    ct = cells.filter(F.col("pred").isNotNull() & F.col("label").isNotNull()).select(*g, "pred", "label", "n")
    m = agree.compute_metrics(ct, group_cols=g, tolerance=tol, from_contingency=True, n_cells=n_cells)
    loss = cells.groupBy(*g).agg(F.try_divide(F.sum("_loss"), F.sum("_terms").cast("double")).alias("value"))
    return m.unionByName(loss.select(*g, F.lit("val_loss").alias("metric"), "value"))


# ------------------------------------------------------------------ fitting

def fit_thresholds(df: DataFrame, vec: str = "pooled", label_idx: str = "label_idx",
                   n_classes: int | None = None, reg_param: float = 1e-3, max_iter: int = 100,
                   score_points: Sequence[float] | None = None, on_pass=None) -> OrdinalHead:
    """Fit a linear ordinal head on frozen vectors.

    Each threshold k has its own weight row and the loss is a plain mean over
    (row, threshold).  All thresholds are fitted together by L-BFGS with L2 ``reg_param``
    (:mod:`rubricon.operators.fit`): at most ``max_iter`` passes over the vectors, one job each, whatever the
    number of classes.  The vectors are checkpointed once to the shared checkpoint folder
    (lineage cut, survives executor loss) and cached.  A threshold whose
    side holds a single class gets zero weights and a smoothed log-odds intercept.
    Rows without a label, without a vector or with a null element teach nothing; without any row left the fit raises.
    ``on_pass(number, head)`` is called after every pass.
    (The reference trains with AdamW weight decay: same model family, different optimiser.)
    """
    from pyspark import StorageLevel

    from rubricon.operators import fit
    from rubricon.session import checkpoint_dir

    checkpoint_dir(df.sparkSession)
    whole = F.col(vec).isNotNull() & ~F.exists(vec, lambda x: x.isNull())
    data = df.filter(F.col(label_idx).isNotNull() & whole).select(
        F.col(vec).cast("array<double>").alias("vec"), F.col(label_idx).cast("int").alias("y"))
    data = data.checkpoint(eager=True).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        # one row per class: as many as the head has thresholds
        counts = {r["y"]: r["n"] for r in data.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
        if not counts:
            raise ValueError("no labelled vector to fit")
        if n_classes is None:
            n_classes = max(counts) + 1
        pts = list(score_points) if score_points is not None else [float(i) for i in range(n_classes)]
        head = lambda coef, intercept: OrdinalHead(coef=coef, intercept=intercept, score_points=pts)
        told = None if on_pass is None else lambda i, *weights: on_pass(i, head(*weights))
        return head(*fit.thresholds(data, n_classes, counts, reg_param, max_iter, on_pass=told))
    finally:
        data.unpersist()


def head_table(spark, head: OrdinalHead) -> DataFrame:
    """Weights of a linear head as a table ``(threshold, coef, intercept)``."""
    rows = [(k, [float(v) for v in head.coef[k]], float(head.intercept[k])) for k in range(head.n_thresholds)]
    return spark.createDataFrame(rows, "threshold int, coef array<double>, intercept double")
