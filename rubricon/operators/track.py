"""Evaluation-log analytics.

Logs are ``(run, step, ..., metric, batch_loss, batch_size)``.  A single run may
hold a large share of all rows, so nothing here sorts a whole run in one task:

* per-run maxima and per-epoch means are plain aggregations (partial
  aggregation absorbs hot runs);
* ordered scans (running best, row numbers) work on fixed-size chunks of a
  run: chunk summaries are cumulated on the small chunk table and joined back,
  and the in-chunk scan is a window partitioned by ``(run, chunk)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rubricon.session import join_keys

STEP_CHUNK = 65_536


def chunked_row_number(df: DataFrame, by: Sequence[str], order: Sequence[str], chunk: Column,
                       out: str = "rn", max_window_rows: int | None = None) -> DataFrame:
    """1-based row number within ``by`` in ``order``, split by a chunk key.

    ``chunk`` must be non-decreasing along ``order`` (for example a time bucket
    of a timestamp that leads the order).  Counts per ``(by, chunk)`` are
    checkpointed and counted once (one bounded action) and cumulated over the
    chunk table — by a window, or by a range-partitioned sort when there are
    millions of chunks; rows are numbered inside their chunk.  A chunk above
    ``max_window_rows`` (a hot run in a short time span) is numbered by a
    range-partitioned sort (:func:`rubricon.operators.prepare.exact_rank`); if
    there are too many such chunks the whole input is ranked that way.
    """
    from rubricon.operators import prepare
    from rubricon.session import broadcast_if_small, materialize_small

    limit = prepare.MAX_WINDOW_ROWS if max_window_rows is None else max_window_rows
    b = list(by)
    d = df.withColumn("_crn_chunk", chunk)
    counts, n_chunks = materialize_small(d.groupBy(*b, "_crn_chunk").agg(F.count(F.lit(1)).alias("_crn_n")))
    if n_chunks <= prepare.MAX_WINDOW_ROWS:
        prev = Window.partitionBy(*b).orderBy("_crn_chunk").rowsBetween(Window.unboundedPreceding, -1)
        offs = counts.withColumn("_crn_off", F.coalesce(F.sum("_crn_n").over(prev), F.lit(0)))
    else:       # very many chunks: running counts by a range-partitioned sort of the chunk table
        offs = (prepare.exact_rank(counts, b, ["_crn_chunk"], "_crn_cum", weight_col="_crn_n")
                       .withColumn("_crn_off", F.col("_crn_cum") - F.col("_crn_n")).drop("_crn_cum"))
    hot = prepare._hot(offs, F.col("_crn_n") > limit, [*b, "_crn_chunk"])
    if hot is None:
        return prepare.exact_rank(df, b, order, out)
    lookup = broadcast_if_small(offs.drop("_crn_n"), n_chunks)
    local = F.row_number().over(Window.partitionBy(*b, "_crn_chunk").orderBy(*order))
    if hot:
        hot_df = df.sparkSession.createDataFrame(hot, offs.select(*b, "_crn_chunk").schema)
        parts = [prepare.among(d, hot_df, [*b, "_crn_chunk"], "left_anti").withColumn("_crn_local", local),
                 prepare.exact_rank(prepare.among(d, hot_df, [*b, "_crn_chunk"], "left_semi"), [*b, "_crn_chunk"],
                                    list(order), "_crn_local")]
    else:
        parts = [d.withColumn("_crn_local", local)]
    out_df = None
    for part in parts:
        r = (join_keys(part, lookup, [*b, "_crn_chunk"])
                 .withColumn(out, (F.col("_crn_local") + F.col("_crn_off")).cast("long"))
                 .drop("_crn_chunk", "_crn_local", "_crn_off"))
        out_df = r if out_df is None else out_df.unionByName(r)
    return out_df


def _measured(log: DataFrame, metric: str) -> DataFrame:
    return log.filter(F.col(metric).isNotNull() & ~F.isnan(F.col(metric).cast("double")))


def improvement_events(log: DataFrame, run: str = "run", step: str = "step", metric: str = "metric",
                       baseline: float = 0.0, chunk_steps: int = STEP_CHUNK) -> DataFrame:
    """Rows whose metric is strictly above the best so far, which starts at ``baseline``.

    Steps without a metric (null or NaN) are not measurements.  Output ``(run, step, metric, prev_best)``.
    """
    d = _measured(log, metric).select(run, step, metric).withColumn("_chunk", F.floor((F.col(step) - 1) / chunk_steps))
    cmax = d.groupBy(run, "_chunk").agg(F.max(metric).alias("_cmax"))
    prev = Window.partitionBy(run).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = cmax.withColumn("_carry", F.max("_cmax").over(prev)).drop("_cmax")
    inner = Window.partitionBy(run, "_chunk").orderBy(step).rowsBetween(Window.unboundedPreceding, -1)
    best_before = F.greatest(F.lit(float(baseline)),
                             F.coalesce(F.col("_carry"), F.lit(float(baseline))),
                             F.coalesce(F.max(metric).over(inner), F.lit(float(baseline))))
    j = join_keys(d, carry, [run, "_chunk"]).withColumn("prev_best", best_before)
    return j.filter(F.col(metric) > F.col("prev_best")).select(run, step, metric, "prev_best")


def best_checkpoint(log: DataFrame, run: str = "run", step: str = "step", metric: str = "metric",
                    baseline: float = 0.0) -> DataFrame:
    """First step reaching each run's maximum; no row when the maximum is not above ``baseline``.

    One aggregation: the minimum of ``(-metric, step)`` picks the highest metric
    and, among equal metrics, the earliest step — deterministic, unlike ``max_by``.
    Steps without a metric (null or NaN) are not measurements.
    """
    best = _measured(log, metric).groupBy(run).agg(
        F.min(F.struct((-F.col(metric)).alias("neg"), F.col(step).alias("s"))).alias("_b"))
    return (best.select(run, F.col("_b.s").alias(step), (-F.col("_b.neg")).alias(metric))
                .filter(F.col(metric) > F.lit(float(baseline))))


def epoch_loss(log: DataFrame, run: str = "run", epoch: str = "epoch", loss: str = "batch_loss",
               size: str = "batch_size") -> DataFrame:
    """Per (run, epoch): unweighted mean of batch losses (D22) and the size-weighted mean."""
    s = F.col(size).cast("double")
    return log.groupBy(run, epoch).agg(
        F.count(F.lit(1)).alias("n_steps"),
        F.avg(loss).alias("train_loss"),
        F.try_divide(F.sum(F.col(loss) * s), F.sum(s)).alias("weighted_loss"))


def logged_steps(log: DataFrame, every: int, step: str = "step") -> DataFrame:
    """Every ``every``-th step."""
    return log.filter(F.pmod(F.col(step), F.lit(every)) == 0)
