"""SimHash near-duplicates by a ball join of whole fingerprints.

Fingerprints: the text's A-Z are lower-cased, words are runs of non-blank
characters, every run of ``shingle_words`` words is hashed with XXH64 (seed 42), and
a bit is 1 when it is set in over half of the hashes.

Search: distinct fingerprints only.  The Hamming ball of radius ``max_bits // 2`` around the
whole fingerprint is enumerated and a table key is the whole flipped fingerprint, so two
fingerprints that differ in at most ``max_bits`` bits meet in at least one key (flip half
of the differing bits of one, the rest of the other).  No segment is searched on its own: a segment
shared by many fingerprints would be a hot bucket.  ``segments`` only orders the flips and must divide 64.  The number of fingerprints around one key is bounded by the
ball, whatever the data: no hot bucket and no list of all pairs.  A key holds its smallest and
largest fingerprint and their number; where there are more than two, the others are fetched by
enumerating the key's own ball.  Every table match is verified by its complete distance
before it becomes a link.

Defined results: null text is the empty text; no words give fingerprint zero, linked
like any other; repeated rows share fingerprint and component; an empty table gives an
empty result; a null ``doc_id`` row gets a component like any other row (the smallest
non-null id reachable, null when there is none).
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rubricon.llm.chunks import text_stretches
from rubricon.llm.common import components, free_name, id_and_text, releasing, row_key, staged, tidied

SEED = 42


def fingerprint(text: str, shingle_words: int) -> int:
    """Unsigned 64-bit SimHash of one text."""
    words = text.encode().lower().split()          # bytes: A-Z and ASCII blanks only
    if not words:
        return 0
    n = max(1, len(words) - shingle_words + 1)
    xx, join = xxhash.xxh64_intdigest, b" ".join
    hashes = np.fromiter((xx(join(words[i:i + shingle_words]), SEED) for i in range(n)), np.uint64, n)
    set_bits = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):                 # very long texts in bounded pieces
        part = hashes[i:i + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        set_bits += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_bits > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle_words: int = 3) -> DataFrame:
    """``(doc_id, fp)``: the fingerprint as a signed long, one row per input row."""
    def run(batches):
        for b in batches:
            for i, j in releasing(text_stretches(b.column(1))):
                fps = [fingerprint(t, shingle_words) for t in b.column(1).slice(i, j - i).to_pylist()]
                yield pa.record_batch([b.column(0).slice(i, j - i), pa.array(np.array(fps, np.uint64).view(np.int64))], names=["doc_id", "fp"])

    return id_and_text(docs).mapInArrow(tidied(run), "doc_id long, fp long")


def flip_masks(segments: int, radius: int) -> list[int]:
    """Signed masks of all flips of up to ``radius`` bits within one segment or spread
    over several (each bit of a mask belongs to the ball of its own segment)."""
    if segments < 1 or 64 % segments:
        raise ValueError("segments must divide 64")
    width = 64 // segments
    bits = [1 << (s * width + i) for s in range(segments) for i in range(width)]
    masks = [0]
    for r in range(1, radius + 1):
        masks += [sum(c) for c in combinations(bits, r)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(fps: DataFrame, max_bits: int = 2, segments: int = 2) -> DataFrame:
    """Verified links ``(a, b)`` among distinct fingerprints ``fp``, enough of them to
    connect everything that is connected: within each table key, all to the smallest."""
    if max_bits % 2 or max_bits < 0:
        raise ValueError("max_bits must be even")
    balls = F.array(*[F.lit(m).cast("long") for m in flip_masks(segments, max_bits // 2)])
    # a few bytes for each fingerprint become a ball of keys: deal them over all tasks first (by another hash than
    # the one that made them distinct, else Spark leaves the dealing out)
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    probes = fps.repartition(n, F.xxhash64("fp")).select("fp", F.explode(balls).alias("mask"))
    keyed = probes.select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("key")).repartition("key")
    table = keyed.groupBy("key").agg(F.min("fp").alias("a"), F.max("fp").alias("b"), F.count("*").alias("n"))
    table = staged(table.where("n > 1"))
    # the third and further fingerprints around a key are among its own ball
    ball = table.where("n > 2").select("a", F.explode(balls).alias("mask"), "key").select("a", F.col("key").bitwiseXOR(F.col("mask")).alias("b"))
    more = ball.where("a <> b").distinct().join(fps.select(F.col("fp").alias("b")), "b", "left_semi")
    pairs = table.where("n = 2").select("a", "b").unionByName(more.select("a", "b"))
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits).distinct()


def near_duplicates(docs: DataFrame, shingle_words: int = 3, max_bits: int = 2) -> DataFrame:
    """``(doc_id, fp, component_id)`` for every row; ``component_id`` is the smallest
    ``doc_id`` reachable over links of at most ``max_bits`` differing bits."""
    marked = staged(fingerprints(docs, shingle_words))
    distinct = staged(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    label = components(links(distinct.select("fp"), max_bits)).withColumnRenamed("node", "fp")
    labelled = distinct.join(label, "fp", "left").select("fp", "first_id", F.coalesce("label", "fp").alias("label"))
    labelled = staged(labelled)
    smallest = labelled.groupBy("label").agg(F.min("first_id").alias("component_id"))
    return marked.join(labelled.join(smallest, "label").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, shingle_words: int = 3, max_bits: int = 2) -> DataFrame:
    """``docs`` with one row of each component: the row of its smallest ``doc_id`` (and of
    several rows with that id, the one with the smallest row key).  Columns are unchanged."""
    from pyspark.sql import Window

    cols = docs.columns
    rid, n = free_name(cols, "__rid"), free_name(cols, "__n")
    keyed = docs.withColumn(rid, row_key())
    ids = keyed.select("doc_id", "text", rid)
    narrow = near_duplicates(ids.select(F.col(rid).alias("doc_id"), "text"), shingle_words, max_bits)
    best = (narrow.withColumnRenamed("doc_id", rid).join(ids.select(rid, "doc_id").distinct(), rid)
            .groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", rid)).alias("m")))
    keep = best.select(F.col("m")[rid].alias(rid))
    once = Window.partitionBy(rid).orderBy(rid)
    kept = keyed.join(keep, rid, "left_semi").withColumn(n, F.row_number().over(once)).where(F.col(n) == 1)
    return kept.select(*cols)
