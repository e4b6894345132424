"""Stand-in inputs derived from the driver's tables (FIXTURES.md §2).

Each builder takes ``(spark, sf_dir)`` and returns a lazy DataFrame whose work
grows with the underlying table.  Only the columns a fixture needs are read,
so the Parquet scans are pruned.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the fixture definitions.
ANS_NULL_MOD, ANS_SPACES_MOD, ANS_EMPTY_MOD = 17, 19, 23
PROB_THRESHOLDS = 9          # K-1 logits; logit j adds up the embedding values d with d % 9 = j
VECTOR_DIM = 64
PROB_LOGIT_SCALE = 4.0
TOK_MASK_PERIOD = 4          # every fourth position is padding
TOK_ALL_MASKED_SEQ = 9       # this sequence has no real token
TOK_POS_CHUNK = 65_536       # vec_id range numbered by one window partition
LOG_EPOCH_STEPS = 5
TOY_MARKER = "@"             # the toy scorer raises on texts containing it


_HANDLES: dict[tuple[int, str], DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Lazy read handle of a driver table, reused within a session.

    Only the DataFrame object is reused (file listing and footer schema); no
    data is cached.  The tables are read-only; :func:`clear_handles` drops them.
    """
    path = f"{sf_dir}/{name}.parquet"
    key = (id(spark), path)
    df = _HANDLES.get(key)
    if df is None or df.sparkSession is not spark:
        df = spark.read.parquet(path)
        _HANDLES[key] = df
    return df


def clear_handles() -> None:
    _HANDLES.clear()


def raw_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-ANS before cleaning: ``(BMH, text, lang)`` with null, blank and empty texts."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    text = (F.when(F.col("doc_id") % ANS_NULL_MOD == 0, F.lit(None).cast("string"))
             .when(F.col("doc_id") % ANS_SPACES_MOD == 0, F.lit("   "))
             .when(F.col("doc_id") % ANS_EMPTY_MOD == 0, F.lit(""))
             .otherwise(F.col("text")))
    return d.select(F.col("doc_id").cast("string").alias("BMH"), text.alias("text"), "lang")


def stored_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(BMH, text, lang)`` with every text as stored."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").cast("string").alias("BMH"), "text", "lang")


def calibration_parts(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """F-CAL as two 'files' split by ``doc_id % 2``; the second lists its columns reversed."""
    lab = table(spark, sf_dir, "labels").select(
        "doc_id", (F.col("quality") + F.lit(0.5) * F.col("toxic")).alias("ZZCJ"))
    bmh = F.col("doc_id").cast("string").alias("BMH")
    even = lab.filter(F.col("doc_id") % 2 == 0).select(bmh, "ZZCJ")
    odd = lab.filter(F.col("doc_id") % 2 == 1).select("ZZCJ", bmh)
    return [even, odd]


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-RATE: ``(l_returnflag, pred, label)`` from lineitem."""
    li = table(spark, sf_dir, "lineitem").select("l_quantity", "l_tax", "l_returnflag")
    label = F.col("l_quantity").cast("double")
    pred = F.greatest(F.lit(1.0), F.least(
        F.lit(50.0), label + F.round(F.col("l_tax") * 100) - F.lit(4.0))).cast("double")
    return li.select("l_returnflag", pred.alias("pred"), label.alias("label"))


def ordinal_probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-PROB: ``(vec_id, logits, probs, label_idx, label)`` with K = 10, score points 0..9."""
    e = table(spark, sf_dir, "embeddings")
    x = lambda d: F.element_at("embedding", d + 1).cast("double")
    logits = F.array(*[F.lit(PROB_LOGIT_SCALE) * sum((x(d) for d in range(j, VECTOR_DIM, PROB_THRESHOLDS)), F.lit(0.0))
                       for j in range(PROB_THRESHOLDS)])
    return (e.select("vec_id", logits.alias("logits"), F.col("label").cast("int").alias("label_idx"))
             .withColumn("probs", F.transform("logits", lambda x: F.lit(1.0) / (F.lit(1.0) + F.exp(-x))))
             .withColumn("label", F.col("label_idx").cast("double")))


def prob_score_points() -> list[float]:
    return [float(v) for v in range(PROB_THRESHOLDS + 1)]


def token_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-TOK: long token table ``(seq_id, pos, mask, vec)``."""
    from rubricon.operators.track import chunked_row_number

    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    # a sequence here is a whole label class, so positions are numbered in vec_id chunks
    numbered = chunked_row_number(e, by=["label"], order=["vec_id"],
                                  chunk=F.floor(F.col("vec_id") / TOK_POS_CHUNK), out="_rn")
    return (numbered.select(F.col("label").cast("long").alias("seq_id"), (F.col("_rn") - 1).cast("int").alias("pos"),
                            F.col("embedding").cast("array<double>").alias("vec"))
             .withColumn("mask", F.when(F.col("seq_id") == TOK_ALL_MASKED_SEQ, F.lit(0))
                                  .when(F.col("pos") % TOK_MASK_PERIOD < TOK_MASK_PERIOD - 1, F.lit(1)).otherwise(F.lit(0))))


def attention_query(dim: int = 64) -> list[float]:
    """Query vector of the attention-pooling fixture: 1/(d+1)."""
    return [1.0 / (d + 1) for d in range(dim)]


def eval_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-LOG: ``(run, step, epoch, metric, batch_loss, batch_size)`` from events.

    ``step`` numbers each run's events by (ts, event_id); it is computed with the
    chunked row number so a run holding a large share of all events is still
    numbered by many tasks.
    """
    from rubricon.operators.track import chunked_row_number

    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "value")
    numbered = chunked_row_number(
        ev.withColumnRenamed("user_id", "run"), by=["run"], order=["ts", "event_id"],
        chunk=F.date_trunc("hour", F.col("ts")), out="step")
    return numbered.select(
        "run", F.col("step").cast("long").alias("step"),
        F.floor((F.col("step") - 1) / LOG_EPOCH_STEPS).cast("long").alias("epoch"),
        F.col("value").alias("metric"), F.col("value").alias("batch_loss"),
        (F.lit(1) + F.col("event_id") % 4).cast("long").alias("batch_size"))


class ToyScorer:
    """score = (length in code points mod 9) / 2; raises on texts holding ``marker``."""

    def __init__(self, marker: str = "@"):
        self.marker = marker

    def __call__(self, texts: list[str]) -> list[float]:
        for t in texts:
            if self.marker in t:
                raise ValueError(f"marker {self.marker} found in text")
        return [(len(t) % 9) / 2 for t in texts]


def toy_factory(marker: str = "@") -> Callable[[], ToyScorer]:
    def make():
        return ToyScorer(marker)
    return make
