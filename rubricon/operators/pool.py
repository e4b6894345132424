"""Pooling token vectors into one vector per sequence.

Input is a long token table ``(seq, pos, mask, vec array<double>)`` — the batch
axis of a (B, L, D) tensor becomes rows.  Vector sums use MLlib's
``Summarizer`` (a JVM aggregate with map-side partial aggregation, one D-wide
add per token), so a sequence's tokens may sit in any partitions and no
per-dimension explode is needed.  ``method="explode"`` gives the plain SQL form
(posexplode + groupBy(seq, dim)) for small D.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rubricon.functions.arrays import ones_mask
from rubricon.functions.ordinal import dot
from rubricon.session import broadcast_if_small, join_keys, materialize_small

POSITION_ROWS = 1_000_000       # rows of a sequence that one window numbers
MAX_CHUNKS = 4_096              # chunks of a longer one


def _vector_sum(df: DataFrame, seq: str, weighted_vec: Column, extra: Sequence[Column],
                method: str) -> DataFrame:
    """Per-sequence sum of ``weighted_vec`` (array<double>) as ``_sum`` plus ``extra`` aggregates."""
    if method == "summarizer":
        s = Summarizer.metrics("sum").summary(array_to_vector(weighted_vec))
        return (df.groupBy(seq).agg(s.alias("_s"), *extra)
                  .withColumn("_sum", vector_to_array(F.col("_s.sum"))).drop("_s"))
    if method == "explode":
        ex = df.select(seq, F.posexplode(weighted_vec).alias("_d", "_v"))
        per_dim = ex.groupBy(seq, "_d").agg(F.sum("_v").alias("_v"))
        arr = per_dim.groupBy(seq).agg(
            F.transform(F.array_sort(F.collect_list(F.struct("_d", "_v"))), lambda x: x["_v"]).alias("_sum"))
        return join_keys(arr, df.groupBy(seq).agg(*extra), [seq]) if extra else arr
    raise ValueError(f"unknown method {method!r}")


def _borders_below(df: DataFrame, borders: str, order: str, n: int, out: str) -> DataFrame:
    """``df`` with ``out``: how many of the at most ``n`` ascending values in the array column ``borders`` lie below ``order`` (none for null).

    A bisection with a column for each of its steps: Spark compiles them and reads the array where it lies, while a lambda over the array is
    interpreted, tests every border and copies the array for every row.
    """
    df = df.withColumn(out, F.lit(0))
    for step in (1 << k for k in reversed(range(n.bit_length()))):
        below = F.get(F.col(borders), F.col(out) + step - 1) < F.col(order)
        df = df.withColumn(out, F.col(out) + F.when(below, step).otherwise(0))
    return df


def with_positions(df: DataFrame, seq: str = "seq_id", order: str = "token_order",
                   out: str = "pos", chunk: Column | None = None, most_rows: int = POSITION_ROWS) -> DataFrame:
    """0-based position inside each sequence when it is not stored (E5).

    The rows of every sequence are counted.  Sequences of at most ``most_rows`` rows are numbered by a window each.  Longer ones are cut into
    chunks at quantiles of ``order``, sketched for these sequences alone (a row a sequence, broadcast within the limit), and numbered chunk by chunk with
    offsets, so a sequence that holds a third of all rows is spread over many tasks.  An ``order`` that has no quantiles (text) is numbered by a
    range-partitioned sort there.  ``chunk``, a key non-decreasing in ``order``, replaces the sketch.  Null sequences are a sequence.
    """
    from pyspark.sql.types import DateType, NumericType, TimestampType

    from rubricon.operators.prepare import among, exact_rank
    from rubricon.operators.track import chunked_row_number

    if chunk is not None:
        return chunked_row_number(df, [seq], [order], chunk, out).withColumn(out, (F.col(out) - 1).cast("int"))
    numbered = (F.row_number().over(Window.partitionBy(seq).orderBy(order)) - 1).cast("int")
    long = df.groupBy(seq).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > most_rows)
    long, n_long = materialize_small(long)
    if not n_long:
        return df.withColumn(out, numbered)
    hot = among(df, long, [seq], "left_semi")
    rest = among(df, long, [seq], "left_anti").withColumn(out, numbered)
    if not isinstance(df.schema[order].dataType, (NumericType, DateType, TimestampType)):
        placed = exact_rank(hot, [seq], [order], out)
    else:
        most = long.agg(F.max("_n")).first()[0]
        steps = min(MAX_CHUNKS, -(-most // most_rows))
        shares = [i / steps for i in range(1, steps)]
        borders, _ = materialize_small(hot.groupBy(seq).agg(F.percentile_approx(order, shares, 20 * steps).alias("_borders")))
        cut = join_keys(hot, broadcast_if_small(borders, n_long * steps), [seq])
        cut = _borders_below(cut, "_borders", order, steps - 1, "_part").drop("_borders")
        placed = chunked_row_number(cut, [seq], [order], F.col("_part"), out).drop("_part")
    return rest.unionByName(placed.withColumn(out, (F.col(out) - 1).cast("int")))


def pool_mean(df: DataFrame, seq: str = "seq_id", vec: str = "vec", mask: str | None = "mask",
              method: str = "summarizer") -> DataFrame:
    """Masked mean ``sum(mask*v) / max(sum(mask), 1)`` (J1); all-masked gives zeros."""
    m = ones_mask(mask).cast("double")
    base = df.select(seq, F.col(vec).cast("array<double>").alias("_v"), m.alias("_m"))
    wv = F.transform("_v", lambda x: x * F.col("_m"))
    agg = _vector_sum(base, seq, wv, [F.sum("_m").alias("_cnt")], method)
    den = F.greatest(F.col("_cnt"), F.lit(1.0))
    return agg.select(seq, F.transform("_sum", lambda x: x / den).alias("pooled"))


def pool_last(df: DataFrame, seq: str = "seq_id", pos: str = "pos", vec: str = "vec",
              mask: str | None = "mask") -> DataFrame:
    """Vector at position ``sum(mask) - 1``; with no real token, the last position.

    The target position of every sequence is a narrow aggregate (no vectors), checkpointed and counted.  Within the broadcast
    limit the token table is scanned and filtered where it is, so no vector but the results is moved; beyond it the
    filter is a shuffled semi-join, which does move vectors.  Null sequences are a sequence.
    """
    m = ones_mask(mask)
    targets, n = materialize_small(df.groupBy(seq).agg(F.sum(m).alias("_s"), F.max(pos).alias("_last")).select(
        F.col(seq).alias("_seq"), F.when(F.col("_s") == 0, F.col("_last")).otherwise(F.col("_s") - 1).cast("int").alias("_tpos")))
    rows = df.select(seq, F.col(pos).cast("int").alias("_pos"), F.col(vec).cast("array<double>").alias("pooled"))
    at = F.col(seq).eqNullSafe(F.col("_seq")) & (F.col("_pos") == F.col("_tpos"))
    return rows.join(broadcast_if_small(targets, n), at, "left_semi").select(seq, "pooled")


class _Softmax:
    """Online-softmax states of sequences, one row each: ``top`` (largest score, null without a real token), ``weight`` and the
    weighted vector sum ``row``.  Without a real token every position weighs the same; such a state vanishes beside one that has some.
    """

    STATE = "top double, weight double, row array<double>"

    @staticmethod
    def fold(keys, top: np.ndarray, weight: np.ndarray, rows: np.ndarray):
        """Merges the states of equal keys; NaN is a null top.  Returns ``(distinct keys, top, weight, rows)``, keys in order of first occurrence."""
        import pyarrow as pa

        keys = keys.combine_chunks() if isinstance(keys, pa.ChunkedArray) else keys
        coded = keys.dictionary_encode(null_encoding="encode")
        code, n = coded.indices.to_numpy(), len(coded.dictionary)
        real = ~np.isnan(top)
        most = np.full(n, -np.inf)
        np.maximum.at(most, code[real], top[real])
        use = real | np.isneginf(most[code])
        code, real, top, weight, rows = code[use], real[use], top[use], weight[use], rows[use]
        factor = np.where(real, np.exp(np.where(real, top - most[code], 0.0)), 1.0)
        order = np.argsort(code, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(code[order]) > 0]) if len(code) else np.zeros(0, int)
        summed = np.add.reduceat(rows[order] * factor[order][:, None], starts, axis=0) if len(code) else rows
        return coded.dictionary, np.where(np.isneginf(most), np.nan, most), np.bincount(code, factor * weight, n), summed


def _matrix(column) -> np.ndarray:
    """An Arrow list column without nulls as a matrix; vectors of different lengths fail the job."""
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if n and (np.diff(column.offsets.to_numpy()) != len(flat) // n).any():
        raise ValueError("token vectors of different lengths")
    return flat.reshape(n, -1)


def pool_attention(df: DataFrame, query: Sequence[float] | Column, seq: str = "seq_id",
                   vec: str = "vec", mask: str | None = "mask", method: str = "states") -> DataFrame:
    """Softmax-weighted sum with a query vector.

    Masked positions get weight 0 unless the whole sequence is masked, in which
    case every position weighs the same (plain mean), as with a lowest-finite
    score fill.

    ``states``: each task folds its tokens into one online-softmax state a sequence (largest score, weight sum, weighted vector sum) and
    only states are shuffled and merged, so no token vector is moved and a hot sequence costs one row a task.  ``explode``: the plain form in
    two aggregations (also for a ``query`` column).  Tokens without a whole vector do not count; null sequences are a sequence.
    """
    whole = F.col(vec).isNotNull() & ~F.exists(vec, lambda x: x.isNull())
    base = df.filter(whole).select(seq, F.col(vec).cast("array<double>").alias("_v"), (ones_mask(mask) != 0).alias("_m"))
    if method == "explode":
        return _attention_by_columns(base, query, seq)
    if method != "states" or isinstance(query, Column):
        raise ValueError(f"unknown method {method!r}, or a query column, which needs 'explode'")
    q = np.array([float(x) for x in query])
    seq_type = base.schema[seq].dataType.simpleString()

    def tokens(batches):
        yield from _folded(batches, lambda b: (np.where(b.column(2).to_numpy(zero_copy_only=False), _matrix(b.column(1)) @ q, np.nan),
                                               np.ones(b.num_rows), _matrix(b.column(1))), False)

    def merge(batches):
        yield from _folded(batches, lambda b: (b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_numpy(), _matrix(b.column(3))), True)

    states = base.select(seq, "_v", "_m").mapInArrow(tokens, f"`{seq}` {seq_type}, {_Softmax.STATE}")
    return states.repartition(seq).sortWithinPartitions(seq).mapInArrow(merge, f"`{seq}` {seq_type}, pooled array<double>")


FOLD_VALUES = 4_000_000         # vector values of the states that a task holds before it passes them on


def _folded(batches, read, final: bool):
    """Folds the states that ``read`` makes of each Arrow batch (keys in its first column).  ``final``: equal keys follow each other, and pooled
    vectors come out; else states, several of one key if a task meets very many keys."""
    import pyarrow as pa

    def out(keys, top, weight, rows):
        lists = lambda m: pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, max(m.shape[1], 1), dtype=np.int32)), pa.array(m.ravel()))
        if final:
            return pa.RecordBatch.from_arrays([keys, lists(rows / weight[:, None])], names=[name, "pooled"])
        return pa.RecordBatch.from_arrays([keys, pa.array(top, mask=np.isnan(top)), pa.array(weight), lists(rows)], names=[name, "top", "weight", "row"])

    held = name = None
    for b in batches:
        if not b.num_rows:
            continue
        name = b.schema.names[0]
        new = (b.column(0), *read(b))
        if held is not None:
            new = (pa.concat_arrays([held[0], new[0]]), *(np.concatenate([x, y]) for x, y in zip(held[1:], new[1:])))
        held = _Softmax.fold(*new)
        if final and len(held[0]) > 1:              # the last key may go on
            yield out(held[0].slice(0, len(held[0]) - 1), *(x[:-1] for x in held[1:]))
            held = (held[0].slice(len(held[0]) - 1), *(x[-1:] for x in held[1:]))
        elif held[3].size > FOLD_VALUES:
            yield out(*held)
            held = None
    if held is not None:
        yield out(*held)


def _attention_by_columns(base: DataFrame, query: Sequence[float] | Column, seq: str) -> DataFrame:
    q = F.array(*[F.lit(float(x)) for x in query]) if not isinstance(query, Column) else query
    scored = base.withColumn("_score", dot(F.col("_v"), q))
    stats = scored.groupBy(seq).agg(F.max(F.when(F.col("_m"), F.col("_score"))).alias("_mx"))
    w = F.when(F.col("_mx").isNull(), F.lit(1.0)).when(F.col("_m"), F.exp(F.col("_score") - F.col("_mx"))).otherwise(F.lit(0.0))
    weighted = join_keys(scored, stats, [seq]).withColumn("_w", w)
    wv = F.transform("_v", lambda x: x * F.col("_w"))
    agg = _vector_sum(weighted, seq, wv, [F.sum("_w").alias("_ws")], "explode")
    return agg.select(seq, F.transform("_sum", lambda x: x / F.col("_ws")).alias("pooled"))


STRATEGIES = ("mean", "last", "attention")      # fixed values


def pool(df: DataFrame, strategy: str = "mean", query: Sequence[float] | None = None, **kw) -> DataFrame:
    """Choose pooling by name (J4); unknown names raise ``ValueError``."""
    if strategy == "mean":
        return pool_mean(df, **kw)
    if strategy == "last":
        return pool_last(df, **kw)
    if strategy == "attention":
        if query is None:
            raise ValueError("attention pooling needs a query vector")
        return pool_attention(df, query, **kw)
    raise ValueError(f"no pooling called {strategy!r}; there are {', '.join(STRATEGIES)}")


def explode_vector(df: DataFrame, keys: Sequence[str], vec: str = "pooled",
                   dim: str = "dim", value: str = "value") -> DataFrame:
    """Long form ``(keys..., dim, value)`` of a vector column."""
    return df.select(*keys, F.posexplode(vec).alias(dim, value)).withColumn(dim, F.col(dim).cast("int"))
