"""Registered queries of the corpus operators and their SQL.

Each query applies its operator to a whole table; digests are derived here, the operators return real outputs.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rubricon.llm import byte_bpe, embed_join, extraction, licenses, line_dedup, merkle, minhash, packing, pitman_yor, quality, simhash, toxicity, whitening
from rubricon.llm.common import crc_fold, table

WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
BYTE_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")     # the vocabulary of byte_bpe_50k.tiktoken


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), WORD_VOCABULARY).drop("ids")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprint and near-duplicate component of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle_words=3, max_bits=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document; every fourth fold of the labels is held out."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), ~toxicity.held_out())
    return toxicity.score(docs, model).select("doc_id", F.coalesce(toxicity.held_out(), F.lit(False)).alias("held_out"), "score",
                                              (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity of every document under the trusted-text model, its language's threshold and the decision."""
    docs = table(spark, sf_dir, "documents")
    return quality.classify(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text, and their likeness."""
    return minhash.edited_likeness(table(spark, sf_dir, "documents"))


def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings at cosine 0.95."""
    return embed_join.near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every confirmed license notice of every document."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op8_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probability of every document; every fifth fold is held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (crc_fold("doc_id", 5) == 1).alias("held"))
    return pitman_yor.score(docs, "held")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What line deduplication leaves of every document."""
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "lines_deleted", F.md5("text").alias("text_md5"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count and digests of every document encoded and decoded again."""
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), BYTE_VOCABULARY)


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root, proof and check of every document."""
    return merkle.audit(table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First four whitened coordinates of every embedding."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extraction.main_text(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_packing, op2_simhash, op3_toxicity, op4_quality, op5_minhash, op6_embeddings, op7_licenses,
                            op8_pitman_yor, op9_line_dedup, op10_byte_bpe, op11_merkle, op12_whitening, op13_extraction)}

# The line windows are compared by their content itself; winnowing only narrows the search.
SQL: dict[str, str] = {"op9_line_dedup": f"""
WITH split AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS arr FROM documents),
every AS (SELECT doc_id, unnest(range(len(arr))) AS pos, unnest(arr) AS raw FROM split),
lines AS (SELECT doc_id, pos, trim(raw, ' ') AS line, length(trim(raw, ' ')) - length(replace(trim(raw, ' '), ' ', '')) + 1 AS words
          FROM every WHERE length(trim(raw, ' ')) > 0),
numbered AS (SELECT *, CAST(sum(words) OVER (PARTITION BY doc_id ORDER BY pos) AS BIGINT) AS upto FROM lines),
placed AS (SELECT *, upto - words AS before FROM numbered),
windows AS (
  SELECT doc_id, min(pos) OVER r AS first, max(pos) OVER r AS last, sum(words) OVER r AS total, string_agg(line, chr(10)) OVER r AS content
  FROM placed WINDOW r AS (PARTITION BY doc_id ORDER BY before RANGE BETWEEN CURRENT ROW AND {line_dedup.MIN_WORDS - 1} FOLLOWING)
  UNION ALL
  SELECT doc_id, min(pos) OVER l, max(pos) OVER l, sum(words) OVER l, string_agg(line, chr(10)) OVER l
  FROM placed WINDOW l AS (PARTITION BY doc_id ORDER BY upto RANGE BETWEEN {line_dedup.MIN_WORDS - 1} PRECEDING AND CURRENT ROW)),
full_windows AS (SELECT DISTINCT doc_id, first, last, content FROM windows WHERE total >= {line_dedup.MIN_WORDS}),
ranked AS (SELECT *, first_value(doc_id) OVER o AS m_doc, first_value(last) OVER o AS m_last
           FROM full_windows WINDOW o AS (PARTITION BY content ORDER BY doc_id, first, last)),
later AS (SELECT doc_id, first, last FROM ranked WHERE doc_id <> m_doc OR first > m_last),
gone AS (SELECT DISTINCT doc_id, unnest(range(first, last + 1)) AS pos FROM later),
kept AS (SELECT e.doc_id, string_agg(e.raw, chr(10) ORDER BY e.pos) AS new_text
         FROM every e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.pos = g.pos WHERE g.pos IS NULL GROUP BY e.doc_id),
counts AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT s.doc_id, CAST(coalesce(c.n, 0) AS INTEGER) AS lines_deleted,
       CASE WHEN s.text IS NULL THEN NULL ELSE md5(coalesce(k.new_text, '')) END AS text_md5
FROM split s LEFT JOIN counts c ON s.doc_id = c.doc_id LEFT JOIN kept k ON s.doc_id = k.doc_id
""",
# Whole rows of every tree at a time; the CRC-32 is folded bit by bit over the digits.
"op11_merkle": """
WITH RECURSIVE
lower_text AS (SELECT *, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
  list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
    lambda c, b: list_reduce(list_prepend(xor(c, b), CAST(range(8) AS BIGINT[])), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))) AS inverted_crc
  FROM documents),
fields AS (SELECT *, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
  || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head FROM lower_text),
leaves AS (SELECT doc_id, coalesce('+' || lang, '') AS tree, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
  CASE WHEN xor(inverted_crc, 4294967295) % 3 = 0 THEN sha256(head || coalesce(strlen(low) || ':' || low, '-')) END AS seen FROM fields),
placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM leaves),
nodes AS (
  SELECT tree, 0 AS level, pos, n, leaf AS digest FROM placed
  UNION ALL
  SELECT tree, any_value(level) + 1, pos // 8, any_value((n + 7) // 8), sha256(string_agg(digest, '' ORDER BY pos)) FROM nodes WHERE n > 1 GROUP BY tree, pos // 8),
subroots AS (SELECT tree, digest AS subroot, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS level, pos, n, subroot AS digest FROM subroots
  UNION ALL
  SELECT any_value(level) + 1, pos // 8, any_value((n + 7) // 8), sha256(string_agg(digest, '' ORDER BY pos)) FROM tops WHERE n > 1 GROUP BY pos // 8),
depth AS (SELECT tree, max(level) AS levels FROM nodes GROUP BY tree),
every AS (SELECT tree, level, pos, n, digest FROM nodes WHERE n > 1
  UNION ALL SELECT d.tree, d.levels + t.level, t.pos, t.n, t.digest FROM tops t CROSS JOIN depth d WHERE t.n > 1),
runs AS (SELECT tree, level, pos // 8 AS run, list(digest ORDER BY pos) AS members FROM every GROUP BY tree, level, pos // 8),
fold AS (
  SELECT p.tree, p.doc_id, p.leaf, p.pos AS leaf_pos, 0 AS level, p.pos, coalesce(seen, leaf) AS node, '' AS proof, d.levels, s.pos AS tree_pos
  FROM placed p JOIN depth d USING (tree) JOIN subroots s USING (tree)
  UNION ALL
  SELECT f.tree, f.doc_id, f.leaf, f.leaf_pos, f.level + 1, f.at // 8,
    sha256(array_to_string(r.members[1:f.at % 8], '') || f.node || array_to_string(r.members[f.at % 8 + 2:], '')),
    f.proof || array_to_string(r.members[1:f.at % 8], '') || array_to_string(r.members[f.at % 8 + 2:], ''), f.levels, f.tree_pos
  FROM (SELECT *, CASE WHEN level = levels THEN tree_pos ELSE pos END AS at FROM fold) f
  JOIN runs r ON r.tree = f.tree AND r.level = f.level AND r.run = f.at // 8)
SELECT f.doc_id, f.leaf, s.subroot, t.digest AS root, sha256(f.proof) AS proof_sha256, f.node AS folded_root, f.node = t.digest AS verified
FROM fold f JOIN subroots s USING (tree) CROSS JOIN (SELECT digest FROM tops WHERE n = 1) t
WHERE f.level = f.levels + (SELECT max(level) FROM tops)
""",
# Every pair of vectors, and the transitive closure of its links.
"op6_embeddings": """
WITH RECURSIVE
v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id
          WHERE list_inner_product(a.x, b.x) / (sqrt(list_inner_product(a.x, a.x)) * sqrt(list_inner_product(b.x, b.x))) >= 0.95),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
component AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT c.vec_id, (SELECT count(*) FROM links l WHERE l.a = c.vec_id) AS n_links, c.component_id, c.vec_id = c.component_id AS kept
FROM component c"""}
