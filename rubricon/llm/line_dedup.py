"""Line deduplication by winnowing over line hashes (DataFrame functions only).

A document is its sequence of non-blank lines (trimmed of ASCII blanks; blank lines take no part, and
go only with a run around them).  A *run* is a stretch of consecutive lines; its length is counted in
words (pieces between ASCII blanks; each character of a script without blanks between words is a word).  A run of at least ``min_words`` words that occurred
earlier, in order of ``(doc_id, row key, line)``, is deleted; an overlapping earlier occurrence
in the same document does not count, so one period of a repetition stays.

Method:

1. Winnowing.  At every line a window opens that closes as soon as it holds ``min_words``
   words; the smallest line hash of the window is a fingerprint.  Any repeated run
   of ``min_words`` words holds a whole window, so it has a fingerprint in common
   with its earlier occurrence: the guarantee.
2. Positions of equal fingerprints are joined.  One key can hold a third of all lines, so
   a key is reduced by map-side minima to its first and last position, never to pairs:
   a fingerprint at one position only cannot belong to a repeated run.
3. Matches are extended both ways from the surviving fingerprints: the windows around them
   that open at a line (to the right) and that close at a line (to the left) are
   compared, by a hash of all their lines, with their first occurrence.  A maximal repeated run
   is exactly the union of its windows of either kind.
4. Lines of windows with an earlier occurrence are deleted; the rest is joined again.

Defined results: null text is the empty text and is returned as null; repeated rows (same id and
text) share one fate; rows with null ids come after all others; an empty table gives an empty one;
other columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rubricon.llm.common import free_name, id_and_text, row_key, staged, whole_text

MIN_WORDS = 50
LINE_BREAK = "\n"
BLANK = r"\x20\x09-\x0D"
UNSPACED = "".join(rf"\p{{Is{script}}}" for script in ("Han", "Hiragana", "Katakana", "Thai", "Lao", "Khmer", "Myanmar"))
WORD = f"[{UNSPACED}]|[^{BLANK}{UNSPACED}]+"
UNEVEN = rf"[\x09-\x0D{UNSPACED}]|  "          # lines without any of these have one space between words


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\n\x0b\x0c\r"))


def _words(line: Column) -> Column:
    spaces = F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit("")))
    return F.when(F.rlike(line, F.lit(UNEVEN)), F.regexp_count(line, F.lit(WORD))).otherwise(spaces + 1).cast("long")


def _lines(docs: DataFrame) -> DataFrame:
    """Non-blank lines: ``(rid, id_key, pos, h, words)``."""
    split = id_and_text(docs).select(
        row_key().alias("rid"), F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id").alias("id_key"),
        F.posexplode(F.split("text", LINE_BREAK)).alias("pos", "line"))
    line = _trimmed(F.col("line"))
    return (split.select("rid", "id_key", "pos", F.xxhash64(line).alias("h"), F.length(line).alias("n"),
                         _words(line).alias("words"))
            .where("n > 0").drop("n").dropDuplicates(["rid", "pos"]))


def _windows(lines: DataFrame, min_words: int) -> DataFrame:
    """Windows ``(rid, id_key, first, last, fingerprint, content)`` of both kinds."""
    doc = Window.partitionBy("rid").orderBy("pos")
    numbered = (lines.withColumn("seq", F.row_number().over(doc))
                .withColumn("upto", F.sum("words").over(doc.rowsBetween(Window.unboundedPreceding, 0)))
                .withColumn("before", F.col("upto") - F.col("words")))
    right = Window.partitionBy("rid").orderBy("before").rangeBetween(0, min_words - 1)
    left = Window.partitionBy("rid").orderBy("upto").rangeBetween(-(min_words - 1), 0)

    def span(w) -> Column:
        return F.struct(F.min("pos").over(w).alias("first"), F.max("pos").over(w).alias("last"),
                        F.sum("words").over(w).alias("total"), F.min("h").over(w).alias("fingerprint"),
                        F.xxhash64(F.collect_list("h").over(w)).alias("content"))

    both = numbered.select("rid", "id_key", span(right).alias("r"), span(left).alias("l"))
    each = both.select("rid", "id_key", F.explode(F.array("r", "l")).alias("w")).select("rid", "id_key", "w.*")
    return each.where(F.col("total") >= min_words).drop("total")


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``(rid, deleted)``: sorted line numbers to delete, for the documents that have any."""
    windows = staged(_windows(_lines(docs), min_words).distinct())
    place = F.struct("id_key", "rid", "first", "last")
    ends = windows.groupBy("fingerprint").agg(F.min(place).alias("lo"), F.max(place).alias("hi"))
    shared = ends.where("lo <> hi").select("fingerprint")
    live = windows.join(shared, "fingerprint", "left_semi")
    first = (live.groupBy("content").agg(F.min(place).alias("m"))
             .select("content", F.col("m.rid").alias("m_rid"), F.col("m.first").alias("m_first"), F.col("m.last").alias("m_last")))
    later = live.join(first, "content").where("(rid = m_rid and first > m_last) or rid <> m_rid")
    gone = later.select("rid", F.explode(F.sequence("first", "last")).alias("pos"))
    return gone.groupBy("rid").agg(F.sort_array(F.collect_set("pos")).alias("deleted"))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with repeated runs deleted from ``text``, and ``lines_deleted``, ``lines_left`` (the
    non-blank lines that remain) as last columns, with underscores before them when they clash."""
    cols = docs.columns
    rid, deleted, lines, stay, new = (free_name(cols, n) for n in ("__rid", "__gone", "__lines", "__stay", "__new"))
    gone = repeated_lines(docs, min_words).select(F.col("rid").alias(rid), F.col("deleted").alias(deleted))
    joined = docs.withColumn(rid, row_key()).join(gone, rid, "left")
    split = joined.withColumn(lines, F.when(F.col(deleted).isNotNull(), F.split(whole_text(), LINE_BREAK)))
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(deleted))
    cut = (split.withColumn(stay, F.when(F.size(lines) > 0, F.transform(left, lambda i: F.get(lines, i))))
           .withColumn(new, F.when(F.col(deleted).isNull(), F.col("text")).otherwise(F.array_join(stay, LINE_BREAK))))
    return cut.select(*[F.col(new).alias("text") if c == "text" else F.col(c) for c in cols],
                      F.coalesce(F.size(deleted), F.lit(0)).alias(free_name(cols, "lines_deleted")),
                      F.when(F.col(deleted).isNotNull(), F.size(F.filter(stay, lambda x: F.length(_trimmed(x)) > 0)))
                      .alias(free_name(cols, "lines_left")))
