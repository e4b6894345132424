"""Agreement between predicted and human scores.

Design: the facts are aggregated once into the contingency table
``(group..., pred, label, n)`` — one shuffle with map-side partial aggregation,
at most (#pred values x #label values) rows per group — which is checkpointed
once (one eager, bounded action), and every metric is computed from that small
table, so the facts and anything upstream of them are processed once.  Undefined statistics (zero variance, empty
denominators) come out as null, never as an ANSI error.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rubricon.session import broadcast_if_small, join_keys, materialize_small

_G = "_grp"

# Error thresholds of the cumulative tolerance curve.
CURVE_LE = [0.0, 0.5, 1.0, 1.5, 2.0, 2.5, 3.0, 3.5, 4.0, 5.0, 6.0, 7.0]
CURVE_GT = [7.0, 8.0, 9.0, 10.0]
WITHIN_HALF = 0.5


def _keys(group_cols: Sequence[str]) -> list[str]:
    return list(group_cols) if group_cols else [_G]


def _ensure_key(df: DataFrame, group_cols: Sequence[str]) -> DataFrame:
    return df if group_cols else df.withColumn(_G, F.lit(0))


def _drop_key(df: DataFrame, group_cols: Sequence[str]) -> DataFrame:
    return df if group_cols else df.drop(_G)


def _div(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def pair(preds: DataFrame, labels: DataFrame, on: str | Sequence[str],
         pred_col: str = "pred", label_col: str = "label", keep: Sequence[str] = ()) -> DataFrame:
    """Pair predictions with labels by key (C5); the reference pairs two lists by position.

    ``keep`` carries extra prediction-side columns (group keys).  Inner join:
    rows without a partner are not scored against anything.
    """
    keys = [on] if isinstance(on, str) else list(on)
    return preds.select(*keys, *keep, pred_col).join(labels.select(*keys, label_col), keys, "inner")


def contingency(df: DataFrame, pred: str = "pred", label: str = "label",
                group_cols: Sequence[str] = ()) -> DataFrame:
    """``(group..., pred, label, n)``; rows with a null pred or label are not counted."""
    return (df.filter(F.col(pred).isNotNull() & F.col(label).isNotNull())
              .groupBy(*group_cols, F.col(pred).cast("double").alias("pred"),
                       F.col(label).cast("double").alias("label"))
              .agg(F.count(F.lit(1)).alias("n")))


def dense_index(values: DataFrame, value_col: str, keys: Sequence[str], out: str) -> DataFrame:
    """0-based dense index of sorted distinct values per key.

    Runs on a table of *distinct values* (at most the number of score points per
    group), never on the facts.
    """
    w = Window.partitionBy(*keys).orderBy(value_col)
    return values.withColumn(out, (F.dense_rank().over(w) - 1).cast("int"))


def snap_within(ct: DataFrame, keys: list[str], tolerance: float) -> DataFrame:
    """Contingency after replacing each pred within ``tolerance`` of its label by the label."""
    adj = F.when(F.abs(F.col("pred") - F.col("label")) <= float(tolerance), F.col("label")) \
           .otherwise(F.col("pred"))
    return ct.groupBy(*keys, adj.alias("pred"), "label").agg(F.sum("n").alias("n"))


def metric_names(tolerance: float | None) -> list[str]:
    names = ["exact_accuracy", "mae", "rmse", "qwk", "kappa", "pearson", "spearman", "acc_0.5"]
    if tolerance is not None:
        names += [f"tolerance_acc({tolerance})", f"tolerance_qwk({tolerance})"]
    return names


def _value_table(ct: DataFrame, keys: list[str], n_cells: int | None = None) -> DataFrame:
    """Per group and observed value (union of preds and labels): ``idx`` (dense index),
    marginals ``mp``/``ml`` and tie-averaged ranks ``rp``/``rl`` of the value among
    preds and among labels.

    The table has at most 2 x ``n_cells`` rows.  Index and running counts come
    from windows over it when that is within ``MAX_WINDOW_ROWS`` (always, for
    score points), otherwise from range-partitioned ranks (:func:`exact_rank`), so
    continuous predictions never put all values of a group in one task.
    """
    from rubricon.operators.prepare import MAX_WINDOW_ROWS, exact_rank

    zero = F.lit(0).cast("long")
    ex = ct.select(*keys, F.inline(F.array(
        F.struct(F.col("pred").alias("v"), F.col("n").alias("np"), zero.alias("nl")),
        F.struct(F.col("label").alias("v"), zero.alias("np"), F.col("n").alias("nl")))))
    vt = ex.groupBy(*keys, "v").agg(F.sum("np").alias("mp"), F.sum("nl").alias("ml"))
    if n_cells is None or 2 * n_cells <= MAX_WINDOW_ROWS:
        upto = Window.partitionBy(*keys).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
        vt = (vt.withColumn("idx", (F.row_number().over(Window.partitionBy(*keys).orderBy("v")) - 1).cast("int"))
                .withColumn("cp", F.sum("mp").over(upto)).withColumn("cl", F.sum("ml").over(upto)))
    else:
        vt = exact_rank(vt, keys, ["v"], "_r").withColumn("idx", (F.col("_r") - 1).cast("int")).drop("_r")
        vt = exact_rank(vt, keys, ["v"], "cp", weight_col="mp")
        vt = exact_rank(vt, keys, ["v"], "cl", weight_col="ml")
    # average 1-based rank of tied values: running count minus half of the ties beyond the first
    return vt.select(*keys, "v", "idx", "mp", "ml",
                     (F.col("cp") - (F.col("mp") - 1) / 2.0).alias("rp"),
                     (F.col("cl") - (F.col("ml") - 1) / 2.0).alias("rl"))


def _indexed(ct: DataFrame, keys: list[str], n_cells: int | None = None) -> DataFrame:
    """Contingency cells with dense indices a (pred), b (label), the label marginal at
    pred and the average ranks of pred and label.

    The value table has at most 2 x ``n_cells`` rows; it is broadcast when that
    counted size is within the limit.
    """
    vt = _value_table(ct, keys, n_cells)
    a = vt.select(*keys, F.col("v").alias("pred"), F.col("idx").alias("a"), F.col("ml").alias("ml_at_pred"),
                  "rp")
    b = vt.select(*keys, F.col("v").alias("label"), F.col("idx").alias("b"), "rl")
    if n_cells is not None:
        a, b = broadcast_if_small(a, 2 * n_cells), broadcast_if_small(b, 2 * n_cells)
    return join_keys(join_keys(ct, a, [*keys, "pred"]), b, [*keys, "label"])


def materialize_contingency(ct: DataFrame) -> tuple[DataFrame, int]:
    """Checkpoint the contingency table once (bounded: #pred values x #label values per group).

    The metrics read it several times; materialising it means everything
    upstream (scans, joins, model scoring) runs once.  Returns ``(ct, n_cells)``.
    """
    return materialize_small(ct)


def _qwk_expr(N, sa, sb, saa, sbb, sdd) -> Column:
    ea, eb = sa / N, sb / N
    den = (saa / N - ea * ea) + (sbb / N - eb * eb) + (ea - eb) * (ea - eb)
    return F.lit(1.0) - _div(sdd / N, F.when(den != 0, den))


def _qwk_moments(t: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    n = F.col("n").cast("double")
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    return t.groupBy(*keys).agg(
        F.sum(n).alias(f"{prefix}N"), F.sum(n * a).alias(f"{prefix}sa"), F.sum(n * b).alias(f"{prefix}sb"),
        F.sum(n * a * a).alias(f"{prefix}saa"), F.sum(n * b * b).alias(f"{prefix}sbb"),
        F.sum(n * (a - b) * (a - b)).alias(f"{prefix}sdd"))


def metrics_wide(ct: DataFrame, group_cols: Sequence[str] = (),
                 tolerance: float | None = None, n_cells: int | None = None) -> DataFrame:
    """One row per group with every metric as a column (names as in :func:`metric_names`).

    Plan: the value table (distinct values with marginals, dense index and
    tie-averaged ranks) is joined to the cells twice and the per-group totals
    once; one aggregation then yields every sum the metrics need.  No window runs
    over the cells.
    """
    keys = _keys(group_cols)
    if n_cells is None:     # otherwise the caller passes an already materialised table and its size
        ct, n_cells = materialize_contingency(_ensure_key(ct, group_cols))
    else:
        ct = _ensure_key(ct, group_cols)
    n = F.col("n").cast("double")
    totals = ct.groupBy(*keys).agg(
        F.sum(n).alias("_tot"), (F.sum(n * F.col("pred")) / F.sum(n)).alias("_mp"),
        (F.sum(n * F.col("label")) / F.sum(n)).alias("_ml"))
    n_groups = n_cells if group_cols else 1         # a group has at least one cell
    t = join_keys(_indexed(ct, keys, n_cells), broadcast_if_small(totals, n_groups), keys)
    mid = (F.col("_tot") + 1.0) / 2.0             # mean of average ranks is (N+1)/2
    t = t.select(*keys, "pred", "label", "n", "a", "b", "ml_at_pred",
                 (F.col("pred") - F.col("_mp")).alias("dp"), (F.col("label") - F.col("_ml")).alias("dl"),
                 (F.col("rp") - mid).alias("rp"), (F.col("rl") - mid).alias("rl"))
    err = F.abs(F.col("pred") - F.col("label"))
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    aggs = [
        F.sum(n).alias("N"),
        F.sum(F.when(F.col("pred") == F.col("label"), n).otherwise(0.0)).alias("s_exact"),
        F.sum(n * err).alias("s_abs"), F.sum(n * err * err).alias("s_sq"),
        F.sum(F.when(err <= WITHIN_HALF, n).otherwise(0.0)).alias("s_half"),
        F.sum(n * a).alias("sa"), F.sum(n * b).alias("sb"), F.sum(n * a * a).alias("saa"),
        F.sum(n * b * b).alias("sbb"), F.sum(n * (a - b) * (a - b)).alias("sdd"),
        F.sum(n * F.col("ml_at_pred")).alias("s_pe"),
        F.sum(n * F.col("dp") * F.col("dl")).alias("sxy"), F.sum(n * F.col("dp") * F.col("dp")).alias("sxx"),
        F.sum(n * F.col("dl") * F.col("dl")).alias("syy"),
        F.sum(n * F.col("rp") * F.col("rl")).alias("rxy"), F.sum(n * F.col("rp") * F.col("rp")).alias("rxx"),
        F.sum(n * F.col("rl") * F.col("rl")).alias("ryy"),
    ]
    if tolerance is not None:
        aggs.append(F.sum(F.when(err <= float(tolerance), n).otherwise(0.0)).alias("s_tol"))
    s = t.groupBy(*keys).agg(*aggs)
    N = F.col("N")
    po, pe = F.col("s_exact") / N, F.col("s_pe") / (N * N)
    den_p = F.sqrt(F.col("sxx") * F.col("syy"))
    den_r = F.sqrt(F.col("rxx") * F.col("ryy"))
    cols = [
        (F.col("s_exact") / N).alias("exact_accuracy"),
        (F.col("s_abs") / N).alias("mae"),
        F.sqrt(F.col("s_sq") / N).alias("rmse"),
        _qwk_expr(N, F.col("sa"), F.col("sb"), F.col("saa"), F.col("sbb"), F.col("sdd")).alias("qwk"),
        _div(po - pe, F.when(F.lit(1.0) - pe != 0, F.lit(1.0) - pe)).alias("kappa"),
        _div(F.col("sxy"), F.when(den_p != 0, den_p)).alias("pearson"),
        _div(F.col("rxy"), F.when(den_r != 0, den_r)).alias("spearman"),
        (F.col("s_half") / N).alias("acc_0.5"),
    ]
    out = s.select(*keys, *cols, *([(F.col("s_tol") / N).alias("_tol_acc")] if tolerance is not None else []))
    if tolerance is not None:
        tq = _qwk_moments(_indexed(snap_within(ct, keys, tolerance), keys, n_cells), keys, "t_")
        tq = tq.select(*keys, _qwk_expr(F.col("t_N"), F.col("t_sa"), F.col("t_sb"), F.col("t_saa"),
                                        F.col("t_sbb"), F.col("t_sdd")).alias("_tol_qwk"))
        out = (join_keys(out, broadcast_if_small(tq, n_groups), keys, "left")
                  .withColumnRenamed("_tol_acc", f"tolerance_acc({tolerance})")
                  .withColumnRenamed("_tol_qwk", f"tolerance_qwk({tolerance})"))
    names = metric_names(tolerance)
    return _drop_key(out.select(*keys, *[F.col(f"`{m}`") for m in names]), group_cols)


def to_long(wide: DataFrame, group_cols: Sequence[str], names: Sequence[str],
            metric_col: str = "metric", value_col: str = "value") -> DataFrame:
    """Unpivot metric columns into ``(group..., metric, value)``."""
    structs = [F.struct(F.lit(m).alias(metric_col), F.col(f"`{m}`").cast("double").alias(value_col))
               for m in names]
    return wide.select(*group_cols, F.inline(F.array(*structs)))


def compute_metrics(df: DataFrame, pred: str = "pred", label: str = "label",
                    group_cols: Sequence[str] = (), tolerance: float | None = None,
                    from_contingency: bool = False, n_cells: int | None = None) -> DataFrame:
    """Metric bundle in long form ``(group..., metric, value)`` (D13); null group keys are a group.

    The tolerance pair is present only when ``tolerance`` is given (``None`` = off).
    A group without rows yields no output row.
    """
    ct = df if from_contingency else contingency(df, pred, label, group_cols)
    wide = metrics_wide(ct, group_cols, tolerance, n_cells if from_contingency else None)
    return to_long(wide, group_cols, metric_names(tolerance))


#: Metrics that need no order of values: each is made of sums over the pairs, so one lazy aggregation gives any choice of them.
SUMMED = ("exact_accuracy", "mae", "rmse", "acc_0.5", "pearson", "kappa")


def choose_metrics(df: DataFrame, names: Sequence[str], pred: str = "pred", label: str = "label",
                   group_cols: Sequence[str] = ()) -> DataFrame:
    """``(group..., name...)``: only what the named metrics need is computed (M1).

    Metrics of :data:`SUMMED` run nothing while the plan is built: their sums are taken in one aggregation over the pairs
    (kappa: over the pairs' counts, and its expected agreement over the values).  ``qwk`` and
    ``spearman`` put the observed values in order, whose number decides how, so they checkpoint the contingency table first.
    """
    unknown = [n for n in names if n not in metric_names(None)]
    if unknown or not names:
        raise ValueError(f"no metric called {', '.join(unknown) or 'nothing'}; there are {', '.join(metric_names(None))}")
    if any(n not in SUMMED for n in names):
        wide = metrics_wide(contingency(df, pred, label, group_cols), group_cols)
        return wide.select(*group_cols, *[F.col(f"`{n}`") for n in names])
    keys = _keys(group_cols)
    one = F.lit(1.0)
    if "kappa" in names:
        pairs, n = _ensure_key(contingency(df, pred, label, group_cols), group_cols), F.col("n").cast("double")
    else:
        p, l = F.col(pred).cast("double").alias("pred"), F.col(label).cast("double").alias("label")
        pairs, n = _ensure_key(df.select(*group_cols, p, l).filter(F.col("pred").isNotNull() & F.col("label").isNotNull()), group_cols), one
    err = F.abs(F.col("pred") - F.col("label"))
    share = lambda hit: F.sum(F.when(hit, n).otherwise(0.0)) / F.sum(n)
    aggs = {"exact_accuracy": share(F.col("pred") == F.col("label")), "mae": F.sum(n * err) / F.sum(n),
            "rmse": F.sqrt(F.sum(n * err * err) / F.sum(n)), "acc_0.5": share(err <= WITHIN_HALF)}
    wanted = [aggs[m].alias(m) for m in names if m in aggs]
    if "kappa" in names:
        wanted += [share(F.col("pred") == F.col("label")).alias("_po"), F.sum(n).alias("_N")]
    if "pearson" in names:
        wanted += _pearson_parts(n, "kappa" in names)
    out = pairs.groupBy(*keys).agg(*wanted)
    if "kappa" in names:
        ends = pairs.select(*keys, F.inline(F.array(F.struct(F.col("pred").alias("v"), n.alias("p"), F.lit(0.0).alias("l")),
                                                    F.struct(F.col("label").alias("v"), F.lit(0.0).alias("p"), n.alias("l")))))
        by_value = ends.groupBy(*keys, "v").agg(F.sum("p").alias("p"), F.sum("l").alias("l"))
        out = join_keys(out, by_value.groupBy(*keys).agg(F.sum(F.col("p") * F.col("l")).alias("_pe")), keys)
        pe = F.col("_pe") / (F.col("_N") * F.col("_N"))
        out = out.withColumn("kappa", _div(F.col("_po") - pe, F.when(one - pe != 0, one - pe)))
    if "pearson" in names:
        den = F.sqrt(F.col("_vx") * F.col("_vy"))
        out = out.withColumn("pearson", _div(F.col("_cxy"), F.when(den != 0, den)))
    return _drop_key(out.select(*keys, *[F.col(f"`{m}`") for m in names]), group_cols)


def _pearson_parts(n: Column, weighted: bool) -> list[Column]:
    """Population covariance and variances of the pairs; of weighted pairs from their moments."""
    x, y = F.col("pred"), F.col("label")
    if not weighted:
        return [F.covar_pop(x, y).alias("_cxy"), F.var_pop(x).alias("_vx"), F.var_pop(y).alias("_vy")]
    mean = lambda c: F.sum(n * c) / F.sum(n)
    return [(mean(x * y) - mean(x) * mean(y)).alias("_cxy"), (mean(x * x) - mean(x) * mean(x)).alias("_vx"), (mean(y * y) - mean(y) * mean(y)).alias("_vy")]


def _one(df, pred, label, group_cols, name):
    return choose_metrics(df, [name], pred, label, group_cols)


def exact_accuracy(df, pred="pred", label="label", group_cols=()):
    return _one(df, pred, label, group_cols, "exact_accuracy")


def mae(df, pred="pred", label="label", group_cols=()):
    return _one(df, pred, label, group_cols, "mae")


def rmse(df, pred="pred", label="label", group_cols=()):
    return _one(df, pred, label, group_cols, "rmse")


def qwk(df, pred="pred", label="label", group_cols=()):
    """Quadratic weighted kappa on dense indices of the observed values.

    QWK = 1 - E[(a-b)^2] / (Var a + Var b + (E a - E b)^2), n-weighted — equal to the
    observed/expected matrix form.
    """
    return _one(df, pred, label, group_cols, "qwk")


def kappa(df, pred="pred", label="label", group_cols=()):
    """Unweighted Cohen's kappa (po - pe) / (1 - pe)."""
    return _one(df, pred, label, group_cols, "kappa")


def pearson(df, pred="pred", label="label", group_cols=()):
    return _one(df, pred, label, group_cols, "pearson")


def spearman(df, pred="pred", label="label", group_cols=()):
    """Pearson r of tie-averaged ranks."""
    return _one(df, pred, label, group_cols, "spearman")


def acc_within(df, threshold: float, pred="pred", label="label", group_cols=()):
    keys = _keys(group_cols)
    ct = _ensure_key(contingency(df, pred, label, group_cols), group_cols)
    n = F.col("n").cast("double")
    err = F.abs(F.col("pred") - F.col("label"))
    out = ct.groupBy(*keys).agg(
        (F.sum(F.when(err <= float(threshold), n).otherwise(0.0)) / F.sum(n)).alias("acc_within"))
    return _drop_key(out, group_cols)


def tolerance_qwk(df, tolerance: float, pred="pred", label="label", group_cols=(),
                  from_contingency: bool = False) -> DataFrame:
    """QWK after snapping preds within ``tolerance`` to the label."""
    keys = _keys(group_cols)
    ct = df if from_contingency else contingency(df, pred, label, group_cols)
    ct, n_cells = materialize_contingency(_ensure_key(ct, group_cols))
    m = _qwk_moments(_indexed(snap_within(ct, keys, tolerance), keys, n_cells), keys, "")
    out = m.select(*keys, _qwk_expr(F.col("N"), F.col("sa"), F.col("sb"), F.col("saa"), F.col("sbb"),
                                    F.col("sdd")).alias("tolerance_qwk"))
    return _drop_key(out, group_cols)


def tolerance_curve(df, pred="pred", label="label", group_cols=(),
                    le: Sequence[float] = CURVE_LE, gt: Sequence[float] = CURVE_GT,
                    from_contingency: bool = False) -> DataFrame:
    """Cumulative error curve ``(group..., op, threshold, share)``.

    ``op='le'`` rows hold the share with |pred-label| <= threshold, ``op='gt'`` rows
    the share above it.  One aggregation computes every threshold as a column,
    then the columns are unpivoted; no join.
    """
    keys = _keys(group_cols)
    ct = df if from_contingency else contingency(df, pred, label, group_cols)
    ct = _ensure_key(ct, group_cols)
    err = F.abs(F.col("pred") - F.col("label"))
    n = F.col("n").cast("double")
    spec = [("le", float(t)) for t in le] + [("gt", float(t)) for t in gt]
    aggs = [F.sum(n).alias("_N")]
    for i, (op, t) in enumerate(spec):
        hit = err <= F.lit(t) if op == "le" else err > F.lit(t)
        aggs.append(F.sum(F.when(hit, n).otherwise(0.0)).alias(f"_s{i}"))
    s = ct.groupBy(*keys).agg(*aggs)
    rows = [F.struct(F.lit(op).alias("op"), F.lit(t).alias("threshold"),
                     (F.col(f"_s{i}") / F.col("_N")).alias("share")) for i, (op, t) in enumerate(spec)]
    return _drop_key(s.select(*keys, F.inline(F.array(*rows))), group_cols)
