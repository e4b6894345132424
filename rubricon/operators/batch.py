"""Batch scoring of a text table with a status per row.

The user's scorer is the one piece of Python in the hot path: a factory
returning ``scorer(texts: list[str]) -> list[float]`` (for example a model
wrapper).  Rows pass through ``mapInArrow`` in one scan, blank ones marked by the JVM: those get
their status and take no place in a chunk.  The scorer is built once per Python
worker and reused, the other rows are re-chunked to ``batch_size`` and scored chunk by chunk.
Only their texts become Python objects; every input column is returned as the Arrow
array it came in, so no value can change.  If a chunk raises, every row of that chunk
is marked failed with the message and the job carries on.  Every input row comes out
exactly once, so the scored table is the input plus ``pred_score``, ``status`` and
``error``.

Batch membership
----------------
By default a batch is ``batch_size`` consecutive non-blank rows of one Spark
partition — no shuffle, but which rows share a batch depends on partitioning.
Pass ``batch_col`` to fix membership by a column: rows with equal values form
one batch (cut into ``batch_size`` chunks if larger); rows are clustered by that
column first (one shuffle), so its values should identify small groups such as
``floor(row_id / batch_size)``.  Rows with a null batch are scored too, spread over all
tasks: which of them share a chunk is not fixed.
``isolate_failures=True`` re-scores a failed chunk row by row so only the
offending rows fail.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rubricon.functions.text import is_blank

# Row statuses.
SUCCESS, SKIPPED, FAILED = "success", "skipped", "failed"

_BLANK = "_blank"
ORDER_CHUNK = 65_536        # row-index range numbered by one window partition

_SCORERS: dict[str, Callable] = {}
_KEEP_SCORERS = 2          # scorers kept per Python worker (most recent calls)


def _scorer(factory: Callable, key: str) -> Callable:
    """Build the scorer once per Python worker and call; older ones are released."""
    s = _SCORERS.pop(key, None)
    if s is None:
        s = factory()
    _SCORERS[key] = s
    while len(_SCORERS) > _KEEP_SCORERS:
        _SCORERS.pop(next(iter(_SCORERS)))
    return s


def _score_chunk(scorer, texts: list[str], isolate: bool):
    try:
        scores = list(scorer(texts))
        if len(scores) != len(texts):
            raise ValueError(f"scorer returned {len(scores)} scores for {len(texts)} texts")
        return [(float(s) if s is not None else None, SUCCESS, None) for s in scores]
    except Exception as e:  # noqa: BLE001 - a failing batch must not stop the job
        if not isolate or len(texts) == 1:
            return [(None, FAILED, str(e))] * len(texts)
        return [r for t in texts for r in _score_chunk(scorer, [t], False)]


def batch_score(df: DataFrame, scorer_factory: Callable[[], Callable[[list[str]], list]],
                text_col: str = "text", batch_size: int = 16, batch_col: str | None = None,
                order_cols: list[str] | None = None, isolate_failures: bool = False) -> DataFrame:
    """Score every row; see the module docstring for batching and failure semantics."""
    marked = df.withColumn(_BLANK, is_blank(text_col))
    if batch_col is not None:
        spread = F.when(F.col(_BLANK) | F.col(batch_col).isNull(), F.monotonically_increasing_id())
        marked = (marked.withColumn("_spread", spread).repartition(F.col(batch_col), F.col("_spread"))
                        .sortWithinPartitions(_BLANK, batch_col, *(order_cols or [])).drop("_spread"))
    return _scored(marked, scorer_factory, text_col, batch_size, batch_col, isolate_failures)


def _scored(marked: DataFrame, scorer_factory: Callable, text_col: str, batch_size: int, batch_col: str | None, isolate: bool,
            drop: tuple[str, ...] = ()) -> DataFrame:
    """Scores rows where they are.  ``marked`` has the column ``_BLANK``; rows of one ``batch_col`` value follow each other."""
    from rubricon.session import ship_package

    ship_package(marked.sparkSession)
    key = uuid.uuid4().hex          # one scorer per Python worker and call
    results = [T.StructField("pred_score", T.DoubleType(), True), T.StructField("status", T.StringType(), False),
               T.StructField("error", T.StringType(), True)]
    gone = {_BLANK, *drop}
    schema = T.StructType([f for f in marked.schema.fields if f.name not in gone] + results)
    names = [f.name for f in schema.fields[:-len(results)]]

    def with_results(rows, score, status, error):
        import pyarrow as pa

        rows = rows.select(names).append_column("pred_score", pa.array(score, pa.float64()))
        rows = rows.append_column("status", pa.array(status, pa.string())).append_column("error", pa.array(error, pa.string()))
        return rows.to_batches()

    def label(rows, stops):
        """Rows of an Arrow table with the results of its chunks, which end at ``stops``."""
        scorer = _scorer(scorer_factory, key)
        texts, got, start = rows.column(text_col).to_pylist(), [], 0
        for stop in stops:
            got += _score_chunk(scorer, texts[start:stop], isolate)
            start = stop
        return with_results(rows, *zip(*got))

    def run(batches):
        # rows of one batch value are contiguous; only the open chunk is carried on, so memory stays
        # bounded even when one value has very many rows
        import pyarrow as pa
        import pyarrow.compute as pc

        carry = None
        for rb in batches:
            rows = pa.Table.from_batches([rb])
            blank = rows.column(_BLANK)
            if pc.any(blank).as_py():
                empty = rows.filter(blank)
                n = empty.num_rows
                yield from with_results(empty, [None] * n, [SKIPPED] * n, [None] * n)
                rows = rows.filter(pc.invert(blank))
            rows = rows if carry is None else pa.concat_tables([carry, rows])
            stops = _stops(rows.column(batch_col) if batch_col else None, rows.num_rows, batch_size)
            stops = stops[:-1] if stops and stops[-1] == rows.num_rows else stops       # may still grow
            done = stops[-1] if stops else 0
            if done:
                yield from label(rows.slice(0, done), stops)
            carry = rows.slice(done)
        if carry is not None and carry.num_rows:
            yield from label(carry, _stops(carry.column(batch_col) if batch_col else None, carry.num_rows, batch_size))

    return marked.mapInArrow(run, schema)


def score_in_scan_order(df: DataFrame, scorer_factory: Callable, text_col: str = "text", batch_size: int = 16,
                        isolate_failures: bool = False) -> DataFrame:
    """Score the rows of a file-backed table in the reference's batches: blank rows are set aside, the others, in the order in which the
    files hold them (files by path), are cut into consecutive batches of ``batch_size`` (M5, C4, E6).

    The order is taken from the scan: a row's place is its file, the block of the file that its task reads, and its position there.  One pass counts the
    rows of every block that are not blank (one row a block, cumulated and broadcast); then every task numbers its rows as it reads them.
    A batch that lies within a block is scored where it was read; only batches that cross from one block to the next are
    brought together by a shuffle, fewer than ``2 * batch_size`` rows a block.  Nothing is sorted.  ``df`` must come straight from files (selections, filters and
    new columns may follow).
    """
    from pyspark.errors import AnalysisException

    from rubricon.session import MAX_BROADCAST_ROWS, materialize_small

    try:
        placed = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"),
                           is_blank(text_col).alias(_BLANK))
    except AnalysisException as e:
        raise ValueError("scan order needs a table read from files; pass order columns instead") from e
    live = placed.filter(~F.col(_BLANK)).groupBy("_file", "_start").agg(F.count(F.lit(1)).alias("_n"))
    blocks, n_blocks = materialize_small(live)
    if n_blocks > MAX_BROADCAST_ROWS:
        raise ValueError(f"{n_blocks} file blocks; raise spark.sql.files.maxPartitionBytes or pass order columns")
    before = Window.partitionBy(F.lit(0)).orderBy("_file", "_start")
    blocks = blocks.select("_file", "_start", "_n", F.row_number().over(before).alias("_block"),
                           (F.sum("_n").over(before.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_off"))
    total = blocks.agg(F.sum("_n")).first()[0] or 0
    placed = placed.join(F.broadcast(blocks), ["_file", "_start"], "left").drop("_file", "_start")     # keeps the order of a task's rows
    helpers = ("_n", "_block", "_off")
    kept = [f for f in placed.schema.fields if f.name not in helpers]
    schema = T.StructType(kept + [T.StructField("_index", T.LongType()), T.StructField("_batch", T.LongType()), T.StructField("_whole", T.BooleanType())])

    def number(batches):
        import numpy as np
        import pyarrow as pa

        seen: dict[int, int] = {}
        for rb in batches:
            ints = lambda c: rb.column(c).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            open_ = ~rb.column(_BLANK).to_numpy(zero_copy_only=False)
            n, block, off = (ints(c) for c in helpers)
            index = np.zeros(rb.num_rows, np.int64)
            for k in np.unique(block[open_]):
                at = np.flatnonzero(open_ & (block == k))
                first = seen.get(k, 0)
                index[at] = off[at] + first + np.arange(len(at))
                seen[k] = first + len(at)
            batch = index // batch_size
            whole = ~open_ | ((batch * batch_size >= off) & (np.minimum((batch + 1) * batch_size, total) <= off + n))
            none = ~open_
            yield pa.RecordBatch.from_arrays([*[rb.column(f.name) for f in kept], pa.array(index, mask=none), pa.array(batch, mask=none), pa.array(whole)],
                                             names=schema.names)

    numbered = placed.mapInArrow(number, schema)
    parts = [numbered.filter("_whole"), numbered.filter("not _whole").repartition("_batch").sortWithinPartitions("_batch", "_index")]
    first, second = (_scored(p, scorer_factory, text_col, batch_size, "_batch", isolate_failures, ("_index", "_batch", "_whole")) for p in parts)
    return first.unionByName(second)


def _stops(keys, n: int, batch_size: int) -> list[int]:
    """Where chunks end: after ``batch_size`` rows, and wherever the batch value changes."""
    import numpy as np

    edges = [0, n]
    if keys is not None and n:
        codes = keys.combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), n]
    return [min(s + batch_size, b) for a, b in zip(edges, edges[1:]) for s in range(a, b, batch_size)]


def input_order_batches(df: DataFrame, order_cols: list[str], text_col: str = "text",
                        batch_size: int = 16, out: str = "batch") -> DataFrame:
    """Batch ids formed as the reference forms them: blank rows are set aside and the
    remaining rows, in input order, are cut into consecutive batches of ``batch_size``.

    The input order (``order_cols``, e.g. a row number of the source file) is
    ranked with :func:`rubricon.operators.track.chunked_row_number` over index
    ranges when it is one integer column, else by
    :func:`rubricon.operators.prepare.exact_rank`, a balanced range-partitioned
    sort; blank rows get a null batch.  Pass the result to
    :func:`batch_score` with ``batch_col=out`` for batch membership identical to
    the reference's.
    """
    from pyspark.sql.types import IntegralType

    from rubricon.operators.prepare import exact_rank
    from rubricon.operators.track import chunked_row_number

    marked = df.withColumn(_BLANK, is_blank(text_col))
    integral = len(order_cols) == 1 and isinstance(df.schema[order_cols[0]].dataType, IntegralType)
    if integral:    # a row index: number 65,536-wide index ranges, offsets from their counts
        ranked = chunked_row_number(marked, [_BLANK], order_cols, F.floor(F.col(order_cols[0]) / ORDER_CHUNK), "_ord")
    else:
        ranked = exact_rank(marked, [_BLANK], order_cols, "_ord")
    # rows without an order come first, as in an ascending sort
    batch = F.when(~F.col(_BLANK), F.floor((F.col("_ord") - 1) / batch_size).cast("long"))
    return ranked.withColumn(out, batch).drop("_ord", _BLANK)


def status_counts(scored: DataFrame) -> DataFrame:
    """Rows per status."""
    return scored.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def score_one(text: str, scorer_factory: Callable) -> float | None:
    """Score a single text (I10): the one-row case of :func:`batch_score`, without Spark."""
    scorer = scorer_factory()
    return float(scorer([text])[0])
