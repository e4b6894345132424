"""Helpers shared by the corpus operators: reading, staging, row keys, components."""

from __future__ import annotations

import pickle
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rubricon.session import checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(col: str = "text") -> Column:
    """The text as stored; a null text is the empty text."""
    return F.coalesce(F.col(col), F.lit(""))


def id_and_text(docs: DataFrame) -> DataFrame:
    """``(doc_id, text)`` with null texts empty; every other column is left behind,
    so extra columns can never clash with the names an operator adds."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))


def free_name(columns: list[str], name: str) -> str:
    """``name`` with as many underscores before it as keep it apart from ``columns`` (whatever their case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"__{name}"
    return name


def row_key() -> Column:
    """64-bit key of a document row from its id and text.

    Rows equal in both are the same document (repeated rows); null ids are allowed.
    """
    return F.xxhash64(F.col("doc_id").cast("string"), whole_text())


def crc_fold(col: str = "doc_id", mod: int = 4) -> Column:
    """``crc32(id as text) mod n``."""
    return F.pmod(F.crc32(F.col(col).cast("string").cast("binary")), F.lit(mod))


def staged(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a Parquet table in the shared checkpoint folder and read it back.

    Cuts the lineage, survives lost executors, and later readers prune columns.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shipped(spark: SparkSession, value):
    """Broadcasts a bounded object with its class, so workers need not have this package; returns its reader."""
    data = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    def read():
        got = pickle.loads(data.value)
        vars(data).pop("_value", None)          # the worker's copy of the bytes; its file stays
        return got

    return read


def release_freed() -> None:
    """Returns the memory that Arrow and the C library hold for later use to the system."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def give_back() -> None:
    """Returns the memory that a reused worker has freed to the system."""
    import gc

    gc.collect()
    release_freed()


def releasing(stretches):
    """``stretches``, one at a time; freed memory is given back after each, so a task never holds that of several."""
    for each in stretches:
        yield each
        release_freed()


def tidied(run):
    """``run`` for ``mapInArrow``, after which the worker gives freed memory back."""
    def whole(batches):
        yield from run(batches)
        give_back()

    return whole


def tidied_group(f, sides: int = 1):
    """``f`` of a group, or of the two ``sides`` of a cogroup, after which the worker gives freed memory back."""
    def one(group):
        try:
            return f(group)
        finally:
            give_back()

    def two(left, right):
        try:
            return f(left, right)
        finally:
            give_back()

    return one if sides == 1 else two


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """Connected components of an undirected edge list ``(a, b)`` of longs.

    Returns ``(node, label)`` for every node that has an edge; nodes share a label
    exactly when they are connected (the label is one of the nodes).

    Each round every node adopts the neighbour (or itself) with the smallest hashed
    id, and edges are rewritten to the adopted ids.  The node and its choice stay
    joined by the rewritten edges, so connectivity is kept while the graph shrinks
    by a constant factor in expectation, also along chains.  Minima are computed
    with map-side aggregation, so a node with very many neighbours is no hot group.
    The driver sees one row count per round, never an edge.
    """
    rank = lambda c: F.struct(F.xxhash64(F.col(c)).alias("h"), F.col(c).alias("id"))
    live = staged(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    steps: list[DataFrame] = []
    for _ in range(max_rounds):
        if live.isEmpty():
            break
        both = live.select("a", "b").unionAll(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        choice = staged(
            both.groupBy("a").agg(F.min(rank("b")).alias("m"))
            .select(F.col("a").alias("node"), F.least(rank("a"), F.col("m"))["id"].alias("label"))
        )
        steps.append(choice)
        pick = lambda side: choice.select(F.col("node").alias(side), F.col("label").alias("l" + side))
        moved = live.join(pick("a"), "a").join(pick("b"), "b").where("la <> lb")
        live = staged(moved.select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct())
    else:
        raise RuntimeError(f"components did not converge in {max_rounds} rounds")
    if not steps:
        return live.select(F.col("a").alias("node"), F.col("b").alias("label"))
    out = steps[-1]
    for prev in reversed(steps[:-1]):
        nxt = out.select(F.col("node").alias("label"), F.col("label").alias("final"))
        out = prev.join(nxt, "label", "left").select("node", F.coalesce("final", "label").alias("label"))
    return out
