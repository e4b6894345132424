"""Length and score profiles.

``describe`` with ``method="exact"`` computes exact, linearly interpolated
percentiles (the pandas/numpy definition) by selection: a sketch brackets each one,
and only the distinct values inside the brackets are put in order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rubricon.functions.text import text_length
from rubricon.operators.prepare import MAX_WINDOW_ROWS, exact_rank
from rubricon.session import broadcast_if_small, join_keys, materialize_small

# Percentiles of the reference's describe call and its bin counts.
PERCENTILES = (0.25, 0.5, 0.75, 0.9, 0.95, 0.99)
LENGTH_BINS = 80
SCORE_BINS = 50

BRACKET_ROWS = 10           # rows for each step of a sketch's accuracy from which percentiles are bracketed by it


def pct_name(p: float) -> str:
    return f"p{round(p * 100):d}"


def describe(df: DataFrame, col: str, group_cols: Sequence[str] = (),
             percentiles: Sequence[float] = PERCENTILES, method: str = "exact",
             accuracy: int = 10000, max_window_rows: int = MAX_WINDOW_ROWS, zeros: str | None = None) -> DataFrame:
    """count, mean, std (n-1), min, percentiles, max of ``col`` per group.

    Null and NaN values are missing; null group keys are a group; ``zeros`` names an
    extra column with the number of values equal to zero.

    ``exact``: a first pass takes the moments and, from a sketch, a bracket around the two ranks that each percentile
    lies between; a second counts the values below each bracket and the distinct values inside it, before the shuffle.
    Only those are put in order (a share of ``4 / accuracy`` of the rows at most, besides ties): by a window, or above ``max_window_rows``
    of them by a range-partitioned sort.  No table of all distinct values is made.  ``approx``: ``percentile_approx``.
    """
    g = list(group_cols)
    x = F.col(col).cast("double")
    if method == "approx":
        aggs = [F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"),
                F.min(x).alias("min")]
        df = df.filter(x.isNotNull() & ~F.isnan(x))
        aggs += [F.percentile_approx(x, float(p), accuracy).cast("double").alias(pct_name(p)) for p in percentiles]
        aggs.append(F.max(x).alias("max"))
        if zeros:
            aggs.append(F.count_if(x == 0).cast("long").alias(zeros))
        return df.groupBy(*g).agg(*aggs)
    if method != "exact":
        raise ValueError(f"unknown method {method!r}")
    base = df.select(*g, x.alias("_x")).filter(F.col("_x").isNotNull() & ~F.isnan("_x"))
    ends = [F.percentile_approx("_x", [min(max(float(p) + s * 2 / accuracy, 0.0), 1.0) for p in percentiles], accuracy).alias(n)
            for s, n in ((-1, "_low"), (1, "_high"))]
    stats = [F.count("_x").alias("count"), F.avg("_x").alias("mean"), F.stddev_samp("_x").alias("std"), F.min("_x").alias("min"), F.max("_x").alias("max")]
    if zeros:
        stats.append(F.count_if(F.col("_x") == 0).cast("long").alias(zeros))
    whole, n_groups = materialize_small(base.groupBy(*g).agg(*stats, *(ends if percentiles else [])))
    whole = whole.filter("count > 0")
    if not percentiles:
        return whole.select(*g, "count", "mean", "std", "min", "max", *([zeros] if zeros else []))
    # the sketch's rank error is far below the bracket's width where it is used; small groups are read whole
    sketched = F.col("count") > BRACKET_ROWS * accuracy
    at = [F.struct(F.lit(i).alias("p"), *[F.when(sketched, F.col(c)[i]).alias(n) for c, n in (("_low", "a"), ("_high", "b"))]) for i in range(len(percentiles))]
    def beside(rows, table):
        """The columns of a group's row of a small table: joined, or without groups literals of its one row."""
        if g:
            return join_keys(rows, broadcast_if_small(table, n_groups), g)
        one = table.first()
        return rows.withColumns({f.name: F.lit(one[f.name]).cast(f.dataType) for f in table.schema.fields})

    if not g and whole.isEmpty():
        return base.sparkSession.createDataFrame([], T.StructType([f for f in whole.schema.fields if f.name in ("count", "mean", "std", "min")]
                                                 + [T.StructField(pct_name(p), T.DoubleType()) for p in percentiles]
                                                 + [f for f in whole.schema.fields if f.name in ("max", zeros)]))
    rows = beside(base, whole.select(*g, "count", "_low", "_high")).select(*g, "_x", F.explode(F.array(*at)).alias("_at"))
    rows = rows.filter(F.col("_at.b").isNull() | (F.col("_x") <= F.col("_at.b")))
    inside = F.when(F.col("_at.a").isNull() | (F.col("_x") >= F.col("_at.a")), F.col("_x")).alias("_v")        # null: below the bracket
    freq, n_freq = materialize_small(rows.groupBy(*g, F.col("_at.p").alias("_p"), inside).agg(F.count(F.lit(1)).alias("_c")))
    if n_freq <= max_window_rows:
        run = Window.partitionBy(*g, "_p").orderBy(F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
        freq = freq.withColumn("_cum", F.sum("_c").over(run))
    else:
        freq = exact_rank(freq, [*g, "_p"], ["_v"], "_cum", weight_col="_c")
    freq = beside(freq, whole.select(*g, "count"))
    share = F.element_at(F.array(*[F.lit(float(p)) for p in percentiles]), F.col("_p") + 1)
    h = (F.col("count") - 1).cast("double") * share
    found = freq.groupBy(*g, "_p").agg(F.min(F.when(F.col("_cum") > F.floor(h), F.col("_v"))).alias("_lo"),
                                       F.min(F.when(F.col("_cum") > F.ceil(h), F.col("_v"))).alias("_hi"), F.first(h - F.floor(h)).alias("_fr"))
    value = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_fr")
    found = found.groupBy(*g).agg(*[F.max(F.when(F.col("_p") == i, value)).alias(pct_name(p)) for i, p in enumerate(percentiles)])
    out = beside(found, whole.drop("_low", "_high"))
    return out.select(*g, "count", "mean", "std", "min", *[pct_name(p) for p in percentiles], "max", *([zeros] if zeros else []))


def _edge(lo: Column, hi: Column, i: Column, bins: int) -> Column:
    """Left edge of bin ``i``: ``lo + i * step``; the edge after the last bin is ``hi`` itself."""
    return F.when(i >= bins, hi).otherwise(i * ((hi - lo) / F.lit(float(bins))) + lo)


def _bin(x: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Bin whose edges enclose ``x`` (closed on the left, the last one on both sides).

    The quotient may miss the bin by one through rounding; the edges decide.
    """
    guess = F.least(F.floor((x - lo) / (hi - lo) * F.lit(float(bins))).cast("int"), F.lit(bins - 1))
    return (F.when(x < _edge(lo, hi, guess, bins), guess - 1)
            .when((guess < bins - 1) & (x >= _edge(lo, hi, guess + 1, bins)), guess + 1).otherwise(guess))


def _range(low, high) -> tuple:
    """Histogram range of the observed minimum and maximum; equal ones widen by 0.5 each way."""
    return (F.when(low == high, low - 0.5).otherwise(low), F.when(low == high, high + 0.5).otherwise(high))


def histogram(df: DataFrame, col: str, bins: int, group_cols: Sequence[str] = ()) -> DataFrame:
    """Equal-width histogram with every bin present ``(group..., bin, lo, hi, n)``.

    Bins span [min, max]; the last bin is closed on the right; when min = max
    the range widens to min +/- 0.5.  A value belongs to the bin whose edges enclose
    it.  Two passes read the one column: minimum and maximum (one eager row without
    groups), then the bins, counted before the shuffle, so a task sends at most ``bins``
    rows a group.  Null and NaN values are left out; null group keys are a group; a table
    without values has no bins.
    """
    g = list(group_cols)
    x = F.col(col).cast("double")
    base = df.select(*g, x.alias("_x")).filter(F.col("_x").isNotNull() & ~F.isnan("_x"))
    ends = [F.min("_x").alias("_mn"), F.max("_x").alias("_mx")]
    every = F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")
    if g:
        ranges, n_groups = materialize_small(base.groupBy(*g).agg(*ends))
        lo, hi = _range(F.col("_mn"), F.col("_mx"))
        ranges = ranges.select(*g, lo.alias("_lo"), hi.alias("_hi"))
        lo, hi = F.col("_lo"), F.col("_hi")
        base = join_keys(base, broadcast_if_small(ranges, n_groups), g)
        all_bins = ranges.select(*g, "_lo", "_hi", every)
    else:
        mn, mx = base.agg(*ends).first()
        lo, hi = _range(F.lit(mn).cast("double"), F.lit(mx).cast("double"))
        all_bins = df.sparkSession.range(0 if mn is None else 1).select(every)
    counts = base.groupBy(*g, _bin(F.col("_x"), lo, hi, bins).alias("bin")).agg(F.count(F.lit(1)).alias("_n"))
    i = F.col("bin")
    return join_keys(all_bins, counts, [*g, "bin"], "left").select(
        *g, "bin", _edge(lo, hi, i, bins).alias("lo"), _edge(lo, hi, i + 1, bins).alias("hi"),
        F.coalesce(F.col("_n"), F.lit(0)).cast("long").alias("n"))


def nonempty_bins(hist: DataFrame) -> DataFrame:
    """Bins with at least one value (the bar labels, D20)."""
    return hist.filter(F.col("n") > 0)


def with_length(df: DataFrame, text: str = "text", out: str = "length") -> DataFrame:
    """Text length in code points with null text counted as empty."""
    return df.withColumn(out, text_length(text, null_as_empty=True))


def length_profile(df: DataFrame, text: str = "text", group_cols: Sequence[str] = (),
                   bins: int = LENGTH_BINS) -> tuple[DataFrame, DataFrame]:
    """L1: ``(describe + n_zero, histogram)`` of text lengths.

    Building the tables runs their bounded actions (see :func:`describe`);
    use :func:`histogram` on :func:`with_length` alone when only the bins are needed.
    """
    lens = with_length(df, text)
    return describe(lens, "length", group_cols, zeros="n_zero"), histogram(lens, "length", bins, group_cols)


def score_profile(df: DataFrame, score: str = "pred_score", group_cols: Sequence[str] = (),
                  bins: int = SCORE_BINS) -> tuple[DataFrame, DataFrame] | None:
    """L2: describe and histogram of non-null scores; ``None`` when the column is absent."""
    if score not in df.columns:
        return None
    s = df.filter(F.col(score).isNotNull())
    return describe(s, score, group_cols), histogram(s, score, bins, group_cols)


def length_vs_score(df: DataFrame, text: str = "text", score: str = "pred_score",
                    keys: Sequence[str] = ()) -> DataFrame:
    """L3: ``(keys..., length, score)`` for rows that have a score."""
    return with_length(df, text).filter(F.col(score).isNotNull()).select(
        *keys, "length", F.col(score).cast("double").alias("score"))


def length_score_bins(df: DataFrame, length_bins: int = LENGTH_BINS, score: str = "score") -> DataFrame:
    """2-D counts ``(bin, score, n)`` of a length-vs-score table — the scalable scatter (L3).

    Length bins follow :func:`histogram`: one pass for the range, one that counts
    cells before the shuffle.
    """
    pairs = df.select(F.col("length").cast("double").alias("_x"), F.col(score).cast("double").alias("score")).filter(
        F.col("_x").isNotNull() & F.col("score").isNotNull())
    mn, mx = pairs.agg(F.min("_x"), F.max("_x")).first()
    lo, hi = _range(F.lit(mn).cast("double"), F.lit(mx).cast("double"))
    return pairs.groupBy(_bin(F.col("_x"), lo, hi, length_bins).alias("bin"), "score").agg(F.count(F.lit(1)).alias("n"))
