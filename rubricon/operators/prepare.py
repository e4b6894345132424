"""Preparing labelled data.

Ordering work that the reference does on one machine — sorted distinct score
points, a seeded train/test permutation, shuffled batches — is re-expressed so
that no window ever runs over the facts without a partition key:

* score points are indexed on the table of *distinct* labels;
* exact splits come from the hash at the cut, found by narrow histograms of the hash, and a comparison with it;
* global shuffle ranks come from counts per 16-bit hash
  bucket (at most 65,536 rows per group), cumulated on that small table, plus a
  row number inside each bucket (about n / 65,536 rows per window partition).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rubricon.functions.arrays import pad_truncate as _pad_truncate
from rubricon.operators.agree import dense_index
from rubricon.session import broadcast_if_small, join_keys, materialize_small

HASH_BUCKET_HEX = 4                 # 16-bit buckets
MAX_BROADCAST_POINTS = 100_000      # score-point rows collected for a broadcast lookup
MAX_WINDOW_ROWS = 4_000_000         # a hash bucket above this is ranked by a range-partitioned sort
MAX_HOT_BUCKETS = 10_000            # hot buckets collected to the driver (bounded list)


def join_labels(answers: DataFrame, calibration: DataFrame, on: str | Sequence[str] = "BMH") -> DataFrame:
    """Inner equi-join of answers and human scores.

    Many-to-many on purpose: a key repeated across calibration files multiplies
    rows exactly like the reference; nothing is de-duplicated.  Null keys never match.
    """
    return answers.join(calibration, on, "inner")


def duplicate_keys(calibration: DataFrame, on: str = "BMH") -> DataFrame:
    """Keys that appear more than once in the calibration table, with their count."""
    return calibration.groupBy(on).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def _score_points_counted(df: DataFrame, label: str, group_cols: Sequence[str]) -> tuple[DataFrame, int]:
    g = list(group_cols)
    vals = (df.select(*g, F.col(label).cast("double").alias("label"))
              .filter(F.col("label").isNotNull()).distinct())
    vals, n = materialize_small(vals)
    if n <= MAX_WINDOW_ROWS:
        keys = g if g else ["_k"]
        v = vals if g else vals.withColumn("_k", F.lit(0))
        pts = dense_index(v, "label", keys, "label_idx")
        pts = pts if g else pts.drop("_k")
    else:       # continuous labels: range-partitioned rank instead of one window
        pts = exact_rank(vals, g, ["label"], "_r").withColumn("label_idx", (F.col("_r") - 1).cast("int")).drop("_r")
    return pts, n


def score_points(df: DataFrame, label: str = "label", group_cols: Sequence[str] = ()) -> DataFrame:
    """Sorted distinct labels with their 0-based index ``(group..., label, label_idx)``.

    The distinct labels are checkpointed once (one bounded action) and indexed by
    a window per group when there are at most ``MAX_WINDOW_ROWS`` of them (score
    points always are), else by a range-partitioned rank.
    """
    return _score_points_counted(df, label, group_cols)[0]


def score_points_preview(points: DataFrame, group_cols: Sequence[str] = (), head: int = 5,
                         tail: int = 3) -> DataFrame:
    """Flag the first ``head`` and last ``tail`` score points of each group (F2)."""
    g = list(group_cols)
    keys = g if g else ["_k"]
    p = points if g else points.withColumn("_k", F.lit(0))
    k = p.groupBy(*keys).agg((F.max("label_idx") + 1).cast("int").alias("K"))
    out = join_keys(p, k if g else F.broadcast(k), keys)      # one row per group
    out = out.withColumn("preview", (F.col("label_idx") < head) | (F.col("label_idx") >= F.col("K") - tail))
    return out if g else out.drop("_k")


def encode_ordinal(df: DataFrame, label: str = "label", group_cols: Sequence[str] = (),
                   max_broadcast_rows: int = MAX_BROADCAST_POINTS) -> tuple[DataFrame, DataFrame]:
    """Add ``label_idx`` (I1, C2).  Returns ``(labelled, points)``.

    The distinct score points are materialised and counted once (a bounded
    action, see :func:`score_points`); the lookup is broadcast when that count is
    within ``max_broadcast_rows`` and otherwise stays a regular join that AQE
    plans at run time.
    """
    g = list(group_cols)
    pts, n = _score_points_counted(df, label, g)
    lookup = broadcast_if_small(pts, n, max_broadcast_rows)
    keyed = df.withColumn("_lbl", F.col(label).cast("double"))
    lk = lookup.withColumnRenamed("label", "_lbl")
    out = join_keys(keyed, lk, [*g, "_lbl"], "left").drop("_lbl")
    return out, pts


def _hash(seed: int | Column, key_cols: Sequence[str], *extra: Column) -> Column:
    parts = [F.lit(str(seed)) if isinstance(seed, int) else seed.cast("string")]
    parts += [e.cast("string") for e in extra]
    parts += [F.col(c).cast("string") for c in key_cols]
    return F.md5(F.concat_ws(":", *parts))


def _bucket(h: Column) -> Column:
    return F.conv(F.substring(h, 1, HASH_BUCKET_HEX), 16, 10).cast("int")


def _orderable(df: DataFrame, exclude: Sequence[str]) -> list[str]:
    """Columns usable as a final tiebreak (every type but maps), in name order."""
    from pyspark.sql.types import MapType
    return sorted(f.name for f in df.schema.fields
                  if f.name not in exclude and not isinstance(f.dataType, MapType))


def exact_rank(df: DataFrame, partition_cols: Sequence[str], order_cols: Sequence[str],
               out: str = "_rank", n_parts: int | None = None, weight_col: str | None = None) -> DataFrame:
    """1-based rank within ``partition_cols`` by ``order_cols``, balanced whatever the skew; null groups are groups.

    The rows are range-partitioned and sorted on (partition, order, unique id):
    the unique id splits even exact copies over many tasks (copies that tie on
    every column are interchangeable, so which copy takes which rank does not
    change the result).  The sorted rows are checkpointed so partition ids and
    positions are stable; a small table of per-partition counts gives each
    partition its offset.  With ``weight_col`` the result is the running sum of
    the weights (inclusive) instead of the row rank; the in-partition running
    sum is a window over one sorted range partition.
    """
    from rubricon.session import checkpoint_dir

    spark = df.sparkSession
    checkpoint_dir(spark)
    p, o = list(partition_cols), list(order_cols)
    n = n_parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Each input partition is sorted before ids are drawn, so a retried map task
    # hands out the same ids to the same rows (only identical rows can swap);
    # the range shuffle then neither duplicates nor loses rows after executor loss.
    srt = (df.sortWithinPartitions(*p, *o).withColumn("_uid", F.monotonically_increasing_id())
             .repartitionByRange(n, *p, *o, "_uid").sortWithinPartitions(*p, *o, "_uid")
             .checkpoint(eager=True))
    pos = srt.withColumn("_pid", F.spark_partition_id()).withColumn("_pos", F.monotonically_increasing_id())
    w = F.lit(1) if weight_col is None else F.col(weight_col)
    stats = pos.groupBy("_pid", *p).agg(F.sum(w).alias("_n"), F.min("_pos").alias("_p0"))
    before = Window.partitionBy(*p).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    stats = stats.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    if not p:   # at most n_parts rows
        stats = F.broadcast(stats)
    ranked = join_keys(pos, stats, ["_pid", *p])
    if weight_col is None:
        local = F.col("_pos") - F.col("_p0") + 1
    else:
        local = F.sum(w).over(Window.partitionBy("_pid", *p).orderBy("_pos")
                              .rowsBetween(Window.unboundedPreceding, 0))
    return (ranked.withColumn(out, F.col("_off") + local)
                  .drop("_uid", "_pid", "_pos", "_p0", "_off"))


def _hot(table: DataFrame, cond: Column, cols: Sequence[str]) -> list | None:
    """Collect the (bounded) list of hot bucket keys; ``None`` when there are more
    than ``MAX_HOT_BUCKETS`` — the data is then simply large and is ranked whole
    by :func:`exact_rank`."""
    rows = table.filter(cond).select(*cols).limit(MAX_HOT_BUCKETS + 1).collect()
    return None if len(rows) > MAX_HOT_BUCKETS else rows


def among(df: DataFrame, listed: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Semi- or anti-join with a bounded list of keys, in which null keys match each other."""
    names = {k: f"_l_{k}" for k in keys}
    other = listed.select(*[F.col(f"`{k}`").alias(n) for k, n in names.items()])
    same = reduce(lambda a, b: a & b, [F.col(f"`{k}`").eqNullSafe(F.col(f"`{n}`")) for k, n in names.items()])
    return df.join(F.broadcast(other), same, how)


def _state(rows: DataFrame, at: DataFrame, n_groups: int, g: list[str]) -> DataFrame:
    """``rows`` with the columns of their group's row of ``at``; plain literals when there are no groups."""
    if not g:
        one = at.first()
        return rows.withColumns({c: F.lit(one[c]).cast(at.schema[c].dataType) for c in at.columns})
    return join_keys(rows, broadcast_if_small(at, n_groups), g)


def cut_hashes(keys: DataFrame, test_size: float, group_cols: Sequence[str] = ()) -> tuple[DataFrame, int]:
    """Where the first ``ceil(n * test_size)`` rows of each group end in the order of the hash column ``_h``.

    Selection, not sorting: a histogram of the hash's first digits finds the bucket in which the cut lies, the next histogram
    reads that bucket only and refines it, until it holds one hash.  Histograms read the group and hash alone and are counted
    before the shuffle, at most 65,536 buckets a group.  Returns ``(group..., _ntest, _before, _ties, _cut)`` and its rows: ``_cut``
    is the hash at the cut (null without test rows), ``_before`` the rows below it, ``_ties`` the rows that have it.
    """
    g = list(group_cols)
    zero = F.lit(0).cast("long")
    n_test = F.ceil(F.count(F.lit(1)).cast("double") * F.lit(float(test_size))).alias("_ntest")
    at, n_groups = materialize_small(keys.groupBy(*g).agg(n_test).select(
        *g, "_ntest", zero.alias("_before"), zero.alias("_ties"), F.lit("").alias("_prefix"), F.lit("").alias("_low"), F.lit("~").alias("_high")))
    still = (F.col("_ntest") > 0) & (F.col("_low") < F.col("_high"))
    for depth in range(HASH_BUCKET_HEX, 32 + 1, HASH_BUCKET_HEX):
        if at.filter(still).isEmpty():
            break
        rows = _state(keys, at, n_groups, g).filter(still & F.col("_h").startswith(F.col("_prefix")))
        counts = rows.groupBy(*g, F.substring("_h", 1, depth).alias("_b")).agg(
            F.count(F.lit(1)).alias("_m"), F.first("_ntest").alias("_ntest"), F.first("_before").alias("_before"),
            F.min("_h").alias("_low"), F.max("_h").alias("_high"))
        upto = Window.partitionBy(*(g or [F.lit(0)])).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
        counts = counts.withColumn("_upto", F.col("_before") + F.sum("_m").over(upto))
        found = counts.filter((F.col("_upto") >= F.col("_ntest")) & (F.col("_upto") - F.col("_m") < F.col("_ntest"))).select(
            *g, "_ntest", (F.col("_upto") - F.col("_m")).alias("_before"), F.col("_m").alias("_ties"), F.col("_b").alias("_prefix"), "_low", "_high")
        at, _ = materialize_small(at.filter(~still).unionByName(found))
    cut = F.when(F.col("_ntest") > 0, F.col("_low")).alias("_cut")
    return at.select(*g, "_ntest", "_before", "_ties", cut), n_groups


def split_exact(df: DataFrame, key_cols: Sequence[str] = ("BMH",), test_size: float = 0.2,
                seed: int = 42, group_cols: Sequence[str] = (),
                tiebreak_cols: Sequence[str] = (), max_window_rows: int = MAX_WINDOW_ROWS) -> DataFrame:
    """Seeded train/test split with exactly ``ceil(n * test_size)`` test rows per group (K1).

    Rows are ordered by ``md5("seed:key")`` then the key and ``tiebreak_cols``; the
    first ``ceil(n * test_size)`` are test.  The hash at the cut is found by selection (:func:`cut_hashes`:
    narrow histograms of the hash, nothing else is read); then every row is labelled where it is, by comparing its hash with
    the cut, a literal of the plan (with groups: one row a group, broadcast within the limit).  Facts are neither shuffled nor checkpointed.
    Only rows that share the hash at the cut (copies of one key), and only if the cut goes through them, are ranked: by a
    window, or above ``max_window_rows`` of them by :func:`exact_rank`.
    Remaining columns break ties after ``tiebreak_cols``, so the result does not
    depend on partitioning and is repeatable for a seed.  Null groups are groups.
    """
    g = list(group_cols)
    h = df.withColumn("_h", _hash(seed, key_cols))
    at, n_groups = cut_hashes(h.select(*g, "_h"), test_size, g)
    through = F.col("_ntest") - F.col("_before") < F.col("_ties")           # some of the ties are test, some train
    ties = at.filter(F.col("_cut").isNotNull() & through).agg(F.max("_ties").alias("most")).first()["most"]
    test = (F.when(F.col("_cut").isNull(), False).when(F.col("_h") != F.col("_cut"), F.col("_h") < F.col("_cut"))
             .when(~through, True))                                          # null: to be ranked
    helpers = ["_h", "_ntest", "_before", "_ties", "_cut"]
    names = F.when(F.col("_test"), "test").otherwise("train")
    j = _state(h, at, n_groups, g).withColumn("_test", test)
    if ties is None:
        return j.withColumn("split", names).drop("_test", *helpers)
    tied = _state(_rows_at_cut(h, at, key_cols, g), at, n_groups, g).withColumn("_test", test).filter(F.col("_test").isNull())
    tb = list(tiebreak_cols) + [c for c in _orderable(df, [*key_cols, *tiebreak_cols, *g])]
    order = [*key_cols, *tb]
    if ties <= max_window_rows:
        tied = tied.withColumn("_rn", F.row_number().over(Window.partitionBy(*g, "_h").orderBy(*order)))
    else:
        tied = exact_rank(tied, [*g, "_h"], order, "_rn")
    tied = tied.withColumn("_test", F.col("_before") + F.col("_rn") <= F.col("_ntest")).drop("_rn")
    return j.filter(F.col("_test").isNotNull()).unionByName(tied).withColumn("split", names).drop("_test", *helpers)


def _rows_at_cut(h: DataFrame, at: DataFrame, key_cols: Sequence[str], g: list[str], most_keys: int = 16) -> DataFrame:
    """The rows that may share the hash at the cut.  Without groups their keys (one, but for collisions) become a predicate
    that the scans below can use."""
    if g:
        return h
    keys = h.filter(F.col("_h") == F.lit(at.first()["_cut"])).select(*key_cols).distinct().limit(most_keys + 1).collect()
    if len(keys) > most_keys:
        return h
    types = h.select(*key_cols).schema
    same = [reduce(lambda a, b: a & b, [F.col(f.name).eqNullSafe(F.lit(r[f.name]).cast(f.dataType)) for f in types]) for r in keys]
    return h.filter(reduce(lambda a, b: a | b, same))


def split_hash(df: DataFrame, key_cols: Sequence[str] = ("BMH",), test_size: float = 0.2,
               seed: int = 42) -> DataFrame:
    """One-pass split: test when the first 32 bits of ``md5("seed:key")`` fall below
    ``test_size``.  No shuffle at all; the test count is approximate."""
    frac = F.conv(F.substring(_hash(seed, key_cols), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    return df.withColumn("split", F.when(frac < F.lit(float(test_size)), "test").otherwise("train"))


def split_counts(split_df: DataFrame, label: str = "label", group_cols: Sequence[str] = ()) -> DataFrame:
    """Row counts per split plus total and number of score points (D15), long form."""
    g = list(group_cols)
    agg = split_df.groupBy(*g).agg(
        F.count(F.lit(1)).alias("total"),
        F.count(F.when(F.col("split") == "train", 1)).alias("train"),
        F.count(F.when(F.col("split") == "test", 1)).alias("test"),
        F.count_distinct(F.col(label)).alias("score_points"))
    items = [F.struct(F.lit(n).alias("item"), F.col(n).cast("long").alias("n"))
             for n in ("total", "train", "test", "score_points")]
    return agg.select(*g, F.inline(F.array(*items)))


def global_rank(df: DataFrame, key_cols: Sequence[str], seed: int, salt: Column | None = None,
                partition_cols: Sequence[str] = (), out: str = "rank",
                max_window_rows: int = MAX_WINDOW_ROWS) -> DataFrame:
    """1-based rank of every row in ``md5("seed:salt:key")`` order within ``partition_cols``.

    Bucket offsets are cumulated on the (bounded) bucket-count table and joined
    back; the row number runs inside each hash bucket only.  Buckets above
    ``max_window_rows`` (hot keys, groups of copies) are ranked by
    :func:`exact_rank` so no task receives a whole hot bucket; finding them is
    one bounded action over the cached bucket table.  Remaining columns break
    ties, so ranks do not depend on partitioning.
    """
    p = list(partition_cols)
    pk = p if p else ["_k"]
    extra = [salt] if salt is not None else []
    tb = _orderable(df, [*key_cols, *p])
    h = df.withColumn("_h", _hash(seed, key_cols, *extra)).withColumn("_b", _bucket(F.col("_h")))
    if not p:
        h = h.withColumn("_k", F.lit(0))
    counts = h.groupBy(*pk, "_b").agg(F.count(F.lit(1)).alias("_m"))
    w = Window.partitionBy(*pk).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offs, n_buckets = materialize_small(counts.withColumn("_off", F.coalesce(F.sum("_m").over(w), F.lit(0))))
    hot = _hot(offs, F.col("_m") > max_window_rows, [*pk, "_b"])
    order = ["_h", *key_cols, *tb]
    if hot is None:             # the data is large everywhere: rank it whole with a balanced sort
        r = exact_rank(h, pk, order, out)
        return r.drop("_h", "_b", *([] if p else ["_k"]))
    lookup = broadcast_if_small(offs.drop("_m"), n_buckets)
    normal = h
    parts = []
    if hot:
        hot_df = df.sparkSession.createDataFrame(hot, offs.select(*pk, "_b").schema)
        parts.append(exact_rank(among(h, hot_df, [*pk, "_b"], "left_semi"), [*pk, "_b"], order, "_rn"))
        normal = among(h, hot_df, [*pk, "_b"], "left_anti")
    rn = F.row_number().over(Window.partitionBy(*pk, "_b").orderBy(*order))
    parts.insert(0, normal.withColumn("_rn", rn))
    out_df = None
    for part in parts:
        r = (join_keys(part, lookup, [*pk, "_b"]).withColumn(out, (F.col("_rn") + F.col("_off")).cast("long"))
                 .drop("_h", "_b", "_rn", "_off", *([] if p else ["_k"])))
        out_df = r if out_df is None else out_df.unionByName(r)
    return out_df


def shuffled_batches(df: DataFrame, key_cols: Sequence[str] = ("BMH",), batch_size: int = 16,
                     epochs: int = 1, seed: int = 42, max_window_rows: int = MAX_WINDOW_ROWS) -> DataFrame:
    """Seeded per-epoch shuffle cut into fixed-size batches, last batch partial (K2, K3).

    Output adds ``epoch``, ``batch_id`` and ``batch_pos``; row order inside an epoch is
    ``md5("seed:epoch:key")``.  ``epochs`` and ``batch_size`` below 1 raise.
    """
    if epochs < 1 or batch_size < 1:
        raise ValueError(f"epochs and batch_size must be at least 1, got {epochs} and {batch_size}")
    per_epoch = df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    ranked = global_rank(per_epoch, key_cols, seed, salt=F.col("epoch"), partition_cols=["epoch"],
                         max_window_rows=max_window_rows)
    r0 = F.col("rank") - 1
    return (ranked.withColumn("batch_id", F.floor(r0 / batch_size).cast("long"))
                  .withColumn("batch_pos", (r0 % batch_size).cast("int")).drop("rank"))


def word_lengths(text: Column | str) -> Column:
    """Toy token ids: split on a single space, id = word length."""
    c = F.col(text) if isinstance(text, str) else text
    return F.transform(F.split(c, " "), lambda w: F.length(w))


def pad_truncate(df: DataFrame, tokens: str, max_length: int = 1024, pad_id: int = 0,
                 side: str = "right", batch_col: str | None = None) -> DataFrame:
    """Add ``input_ids`` and ``attention_mask``.

    Without ``batch_col`` every row is padded to exactly ``max_length`` (training
    and single-text scoring); with it, rows are padded to the longest sequence of
    their batch, capped at ``max_length`` (batch scoring): rows of a batch are brought together by one shuffle, and the Arrow pass that reads
    them pads each batch as a whole, holding one batch and one Arrow batch of rows.  Rows without a batch are padded to their own
    length and stay spread over all tasks.  Null token arrays have null ids and masks, and no length.
    """
    if batch_col is not None:
        return _pad_in_batches(df, tokens, max_length, pad_id, side, batch_col)
    ids, mask = _pad_truncate(F.col(tokens), F.lit(max_length), pad_id, side)
    return df.withColumn("input_ids", ids).withColumn("attention_mask", mask)


def _pad_in_batches(df: DataFrame, tokens: str, max_length: int, pad_id: int, side: str, batch_col: str) -> DataFrame:
    if side not in ("right", "left"):
        raise ValueError(f"side must be 'right' or 'left', got {side!r}")
    ints = T.ArrayType(T.IntegerType())
    schema = T.StructType([*df.schema.fields, T.StructField("input_ids", ints), T.StructField("attention_mask", ints)])
    spread = F.when(F.col(batch_col).isNull(), F.monotonically_increasing_id())
    clustered = (df.withColumn("_spread", spread).repartition(F.col(batch_col), F.col("_spread"))
                   .sortWithinPartitions(batch_col, "_spread").drop("_spread"))
    names = df.columns

    def padded(rows):
        """Whole batches, one after the other."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        column = rows.column(tokens).combine_chunks()
        column = column if not isinstance(column, pa.ChunkedArray) else pa.concat_arrays(column.chunks)
        null = column.is_null().to_numpy(zero_copy_only=False)
        size = np.minimum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False), max_length)
        keys = rows.column(batch_col).combine_chunks()
        codes = keys.dictionary_encode(null_encoding="encode")
        codes = (codes if not isinstance(codes, pa.ChunkedArray) else codes.combine_chunks()).indices.to_numpy()
        alone = keys.is_null().to_numpy(zero_copy_only=False)
        longest = np.zeros(codes.max() + 1, np.int64)
        np.maximum.at(longest, codes, size)
        width = np.where(null, 0, np.where(alone, size, longest[codes]))
        start = column.offsets.to_numpy()[:-1]
        ends = np.concatenate([[0], np.cumsum(width)])
        row = np.repeat(np.arange(len(width)), width)
        place = np.arange(ends[-1]) - ends[row]
        if side == "left":
            place = place - (width - size)[row]
        real = (place >= 0) & (place < size[row])
        values = column.values.to_numpy(zero_copy_only=False)
        ids = np.full(ends[-1], pad_id, np.int32)
        ids[real] = values[start[row[real]] + place[real]]
        lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(v.astype(np.int32)), mask=pa.array(null)) for v in (ids, real)]
        out = rows.append_column("input_ids", lists[0]).append_column("attention_mask", lists[1])
        return out.to_batches()

    def run(batches):
        import numpy as np
        import pyarrow as pa

        carry = None
        for rb in batches:
            if not rb.num_rows:
                continue
            rows = pa.Table.from_batches([rb])
            rows = rows if carry is None else pa.concat_tables([carry, rows])
            keys = rows.column(batch_col).combine_chunks().dictionary_encode(null_encoding="encode")
            codes = (keys if not isinstance(keys, pa.ChunkedArray) else keys.combine_chunks()).indices.to_numpy()
            edges = np.flatnonzero(np.diff(codes))
            done = int(edges[-1]) + 1 if len(edges) else 0                  # the last batch may go on
            if done:
                yield from padded(rows.slice(0, done))
            carry = rows.slice(done)
        if carry is not None and carry.num_rows:
            yield from padded(carry)

    return clustered.select(*names).mapInArrow(run, schema)


def prepare_labelled(answers: DataFrame, calibration: DataFrame, test_size: float = 0.2,
                     seed: int = 42, group_cols: Sequence[str] = (),
                     key_cols: Sequence[str] = ("BMH",)) -> tuple[DataFrame, DataFrame]:
    """Whole prepare step (K5): join, ordinal-encode, split.

    Returns ``(labelled_with_split, points)``; filter ``split`` for the two sides.
    Score points come from the labels alone and the cut from keys alone (their joins read no text), so the joined facts
    are computed once, where the result is used, and never written or shuffled for the split.
    """
    joined = join_labels(answers, calibration)
    labelled, pts = encode_ordinal(joined, "label", group_cols)
    out = split_exact(labelled, key_cols, test_size, seed, group_cols,
                      tiebreak_cols=[c for c in ("text", "label") if c in labelled.columns])
    return out, pts


def encode_examples(labelled: DataFrame, tokens: str, max_length: int = 1024, pad_id: int = 0,
                    side: str = "right") -> DataFrame:
    """Training examples ``(input_ids, attention_mask, label, label_idx, text)`` (K4).

    Written with ``df.write.parquet`` they are the sharded dataset a trainer reads.
    """
    out = pad_truncate(labelled, tokens, max_length, pad_id, side)
    keep = [c for c in ("BMH", "input_ids", "attention_mask", "label", "label_idx", "text") if c in out.columns]
    return out.select(*keep)
