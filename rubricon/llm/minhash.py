"""Document fingerprints: one-permutation MinHash with optimal densification and b-bit codes
(DataFrame functions only).

A text's lower-cased words (runs of characters other than ASCII blanks) form shingles of
``SHINGLE`` words (a shorter text is one shingle).  Every shingle is hashed once; the top eight
bits choose one of ``BINS`` bins and each bin keeps its smallest hash.  An empty bin borrows from a
non-empty one: it tries the bins of its own fixed random sequence until one holds a value (after
``TRIES`` of them: the non-empty bin that comes first in its random order over all bins).  The
low ``BITS`` bits of each bin are stored as two hex digits.  Likeness is the share of equal codes,
corrected for codes that agree by chance: ``(m - 2^-b) / (1 - 2^-b)``, within 0 and 1.

Everything happens within a row: no shuffle, no exploded shingle and no group.

Defined results: null text is the empty text; a text without words has the empty string as its fingerprint,
likeness 1 to another such text and 0 to any other; equal texts have equal fingerprints; ties
and repeated shingles do not matter (minima).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rubricon.llm.common import id_and_text, row_key

SHINGLE = 5
BINS = 256          # the top 8 bits of a 64-bit hash
BITS = 8
TRIES = 8
LOW = (1 << 56) - 1


def _slot(h: Column) -> Column:
    """Place of a hash's bin in ascending signed order, 0 to ``BINS - 1``."""
    return F.shiftright(h, 56) + BINS // 2


def _empty(h: Column) -> Column:
    return h.bitwiseAND(F.lit(LOW)) == F.lit(LOW)


def _donor(slot: Column, attempt: int) -> Column:
    """The slot that ``slot`` tries at this attempt, from a hash of both."""
    return F.xxhash64(slot, F.lit(attempt)).bitwiseAND(F.lit(BINS - 1)).cast("int")


def with_codes(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds ``out``: array of ``BINS`` codes, empty for a text without words.

    Intermediate arrays are columns of their own that are used at least twice each, so the optimizer
    computes each once per row and does not copy them into the functions over elements.
    """
    words, hashes, mins, bins, full, own = (f"__{out}_{x}" for x in ("words", "hashes", "mins", "bins", "full", "own"))
    pieces = F.split(F.lower(F.col(text)), r"[ \x09-\x0D]+")
    df = df.withColumn(words, F.filter(pieces, lambda w: w != ""))
    df = df.withColumn(words, F.when(F.size(words) >= 0, F.transform(words, lambda w: F.xxhash64(w))))
    n = F.size(words)
    shingle = lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(SHINGLE)])
    df = df.withColumn(hashes, F.when(n == 0, F.array().cast("array<bigint>")).when(n < SHINGLE, F.array(F.xxhash64(words)))
                       .otherwise(F.transform(F.sequence(F.lit(0), n - SHINGLE), shingle)))
    sentinels = F.array(*[F.lit(((s - BINS // 2) << 56) | LOW) for s in range(BINS)])
    df = df.withColumn(mins, F.sort_array(F.concat(hashes, sentinels)))
    first = lambda x, i: (i == 0) | (_slot(x) != _slot(F.get(mins, i - 1)))
    df = df.withColumn(bins, F.when(F.size(mins) >= 0, F.filter(mins, first)))
    df = df.withColumn(full, F.when(F.size(bins) >= 0, F.filter(bins, lambda y: ~_empty(y))))
    code = lambda x: x.bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")
    df = df.withColumn(own, F.when(F.size(bins) >= 0, F.transform(bins, lambda x: F.when(~_empty(x), code(x)))))

    def filled(x: Column, slot: Column) -> Column:
        order = lambda y: F.struct(F.xxhash64(slot, _slot(y)).alias("r"), y.alias("v"))
        return F.coalesce(x, *[F.get(own, _donor(slot, t)) for t in range(TRIES)], code(F.array_min(F.transform(full, order))["v"]))

    df = df.withColumn(out, F.when(F.size(full) == 0, F.array().cast("array<int>")).otherwise(F.transform(own, filled)))
    return df.drop(words, hashes, mins, bins, full, own)


def packed(codes: str) -> Column:
    """The stored fingerprint: two hex digits for each bin."""
    return F.array_join(F.transform(codes, lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")


def likeness(a: str, b: str) -> Column:
    """Estimated Jaccard similarity of two code arrays, corrected for chance."""
    chance = 2.0 ** -BITS
    share = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda z: z)) / F.lit(float(BINS))
    corrected = F.greatest(F.lit(0.0), (share - chance) / (1 - chance))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.when(F.size(a) == F.size(b), 1.0).otherwise(0.0)).otherwise(corrected)


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, fingerprint)`` of every row."""
    return with_codes(id_and_text(docs), "text", "codes").select("doc_id", packed("codes").alias("fingerprint"))


def with_next(docs: DataFrame) -> DataFrame:
    """Rows ``(doc_id, text, next_text, bucket, ...)`` beside the next document's text, ascending
    ``doc_id`` (nulls last; equal ids by row key); after the last comes the first.

    Ids are cut into buckets at approximate quantiles, one bucket for each shuffle partition, and texts
    are shuffled once.  The first document of a bucket is also sent to the one before it, so no
    bucket needs another.  Copies stay in the result (``copy = 1``) for a further ``lead``.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    top = (1 << 63) - 1
    keyed = id_and_text(docs).select("doc_id", "text", F.coalesce("doc_id", F.lit(top)).alias("k"), row_key().alias("rid"))
    q = keyed.agg(F.min("k").alias("lo"), F.percentile_approx("k", [i / n for i in range(1, n)] or [0.5], 100 * n).alias("cuts")).first()
    lo = q["lo"] if q["lo"] is not None else 0
    cuts = sorted({c for c in (q["cuts"] or []) if c > lo})
    marks = F.array(*[F.lit(c) for c in cuts]).cast("array<bigint>")
    at = F.size(F.filter(marks, lambda c: c <= F.col("k")))
    one = lambda bucket, copy, wrap: F.struct(bucket.alias("bucket"), F.lit(copy).alias("copy"), F.lit(wrap).alias("wrap"))
    places = F.array_compact(F.array(one(at, 0, 0), F.when(F.array_contains(marks, F.col("k")), one(at - 1, 1, 0)),
                                     F.when(F.col("k") == lo, one(F.lit(len(cuts)), 1, 1))))
    dealt = keyed.select("*", F.explode(places).alias("p")).select("doc_id", "text", "k", "rid", "p.*")
    return dealt.withColumn("next_text", F.lead("text").over(by_bucket()))


def by_bucket():
    return Window.partitionBy("bucket").orderBy("wrap", "k", "rid", "copy")


def edited(text: str, following: str) -> Column:
    """The last half of the code points replaced by as many from the start of ``following``."""
    half = F.floor(F.char_length(text) / 2).cast("int")
    return F.concat(F.substring(F.col(text), F.lit(1), F.char_length(text) - half), F.substring(F.col(following), F.lit(1), half))


def edited_likeness(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and the likeness of a document to its edited
    text and to the next document."""
    both = with_next(docs).withColumn("edited", F.when(F.col("copy") == 0, edited("text", "next_text")))
    both = both.select("doc_id", "bucket", "wrap", "k", "rid", "copy", "text", "edited",
                       F.char_length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"))
    coded = with_codes(both, "text", "codes").drop("text")
    coded = with_codes(coded, "edited", "edited_codes").drop("edited")
    coded = coded.withColumn("next_codes", F.lead("codes").over(by_bucket())).where("copy = 0")
    return coded.select("doc_id", "n_chars", "edited_sha256", packed("codes").alias("fingerprint"),
                        packed("edited_codes").alias("edited_fingerprint"), likeness("codes", "edited_codes").alias("near_edited"),
                        likeness("codes", "next_codes").alias("near_next"))
