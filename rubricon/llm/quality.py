"""Quality by an interpolated modified Kneser-Ney model of trusted text.

The model predicts the bytes of a word from the ``ORDER - 1`` bytes before them, across the blank into the words before, and
whether a word just repeats the one before it.  Count tables stay distributed while
they are smoothed: context totals, discounts and continuation counts are joined to the n-grams by the context's
key, shard by shard.  A document's perplexity is ``exp`` of minus its mean log-likelihood per byte (a
repeated word counts as one symbol).  A document is rejected when its perplexity lies above the threshold of its
language: ``MARGIN`` times the ``QUANTILE`` quantile among all trusted texts of that language that no count has seen, shrunk
towards the quantile of all languages: a weighted geometric mean, the language's weight being its number of such texts and the pooled
one's ``MIN_ROWS``.  Languages without any, and null, take the pooled quantile.

No trusted text is left out: three quarters of them, by a hash of the id, are all counted, and all others are for the thresholds.  A model
of at most ``MAX_GRAMS`` n-grams is broadcast, and scoring takes no shuffle.  A larger one is cut into parts of about that size
by the bytes before the predicted one; the texts are scored once with each part, the parts' sums are added, and neither the driver
nor a task holds more than a part.  Thresholds come from a join of the narrow scores with the labels.

Defined results: null and empty texts hold no word: perplexity null, kept; repeated rows share one fate; rows with null
labels or ids are not trusted; an empty table gives an empty one; without any trusted row nothing is rejected.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rubricon.llm.chunks import text_stretches
from rubricon.llm.common import free_name, releasing, shipped, staged, tidied, whole_text
from rubricon.llm.wordgrams import Model, Words, WordScores, count_grams, fit, fit_part, part_of, tables
from rubricon.session import broadcast_if_small

ORDER = 5
QUANTILE = 0.99
MARGIN = 1.25
MIN_ROWS = 50
MAX_GRAMS = 2_000_000           # n-grams of a model, or of a part of it, that are broadcast
SKETCH = 10_000                 # the sketch that brackets a quantile is exact to one in so many rows
BRACKETED = 100_000             # rows of a language from which it is bracketed; at least 2 * SKETCH
MAX_LANGUAGES = 100_000         # thresholds that are broadcast
STRETCH = 1_200_000             # bytes of text scored together


class Quality:
    """The fitted model, or one part of it, with the tables it comes from; picklable without these."""

    def __init__(self, model: Model | None, p_same: float, unseen: DataFrame | None = None, levels: list[DataFrame] | None = None, part: int = 0, parts: int = 1):
        self.model, self.p_same, self.part, self.parts = model, p_same, part, parts
        self.unseen = unseen                     # ids of the trusted texts that no count has seen: a table
        self.levels = levels                     # the smoothed tables of a model in several parts

    def __getstate__(self):
        return {**self.__dict__, "unseen": None, "levels": None}

    def of_part(self, part: int) -> Quality:
        return self if part == self.part else Quality(fit_part(self.levels, part, self.parts), self.p_same, None, None, part, self.parts)

    def log_probs(self, keys: np.ndarray) -> np.ndarray:
        """Of the n-grams that this part scores; 0 for the others."""
        if self.parts == 1:
            return np.log(self.model.prob(keys))
        out, own = np.zeros(len(keys)), part_of(keys, self.parts) == self.part
        out[own] = np.log(self.model.prob(keys[own]))
        return out

    def scores(self) -> WordScores:
        return WordScores(ORDER, self.log_probs)

    def sums(self, texts, scores: WordScores) -> tuple[np.ndarray, np.ndarray]:
        """For each of a list or an Arrow array of texts this part's share of the log-likelihood, and the symbols (0 without a word)."""
        words = Words(texts, ORDER, once=True)
        first = np.bincount(words.text, minlength=words.n)
        total = np.bincount(words.text, scores.of(words), words.n)
        if self.part == 0:                       # repeated words, once for all parts
            total = total + words.same * np.log(self.p_same) + first * np.log1p(-self.p_same)
        return total, np.bincount(words.text, words.size, words.n).astype(np.int64) + first + words.same

    def perplexities(self, texts, scores: WordScores) -> list[float | None]:
        total, symbols = self.sums(texts, scores)
        value = np.exp(-total / np.maximum(symbols, 1)).tolist()
        return [v if n else None for v, n in zip(value, symbols.tolist(), strict=True)]


def train(docs: DataFrame, labels: DataFrame, max_rows: int | None = None) -> Quality:
    """The model of documents of ``labels.quality = 1``: counts from three quarters of them.  With ``max_rows`` counts come from three
    quarters of a sample of so many, and the others are for the thresholds."""
    trusted = labels.where("doc_id is not null and quality = 1").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    hashed = trusted.withColumn("h", F.xxhash64("doc_id"))
    if max_rows is not None:
        hashed = hashed.orderBy("h", "doc_id").limit(max_rows)
    learners = staged(hashed.where(F.pmod(F.shiftright("h", 20), F.lit(4)) > 0).select("doc_id"))
    listed = broadcast_if_small(learners, learners.count())
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    learn = staged(texts.join(listed, "doc_id", "left_semi").select("text", F.lit(0).alias("cls")))
    counts = staged(count_grams(learn, ORDER, once=True))
    if counts.isEmpty():
        return Quality(None, 0.5)

    def repeats(batches):
        for b in batches:
            for i, j in releasing(text_stretches(b.column(0), STRETCH)):
                words = Words(b.column(0).slice(i, j - i), ORDER, once=True)
                yield pa.record_batch([pa.array([len(words.text)], pa.int64()), pa.array([int(words.same.sum())], pa.int64())], names=["first", "same"])

    r = learn.select("text").mapInArrow(tidied(repeats), "first long, same long").agg(F.sum("first").alias("f"), F.sum("same").alias("s")).first()
    p_same, unseen = (r["s"] + 0.5) / (r["f"] + r["s"] + 1.0), trusted.join(listed, "doc_id", "left_anti")
    parts = -(-counts.count() // MAX_GRAMS)
    if parts == 1:
        return Quality(fit(counts, "c0", ORDER, True), p_same, unseen)
    levels = [staged(t) for t in tables(counts, "c0", ORDER, True)]
    return Quality(fit_part(levels, 0, parts), p_same, unseen, levels, 0, parts)


def thresholds(scored: DataFrame, fitted: Quality, quantile: float = QUANTILE, margin: float = MARGIN) -> DataFrame:
    """``(lang, threshold)``, a row for each language of trusted texts that no count has seen and one without language for all
    others; no row if there are no such texts.  ``scored`` has ``(doc_id, lang, perplexity)``: only these narrow rows are joined.

    Quantiles are exact and interpolated: the rows of a group of more than ``BRACKETED`` are cut down by a sketch to those between two ranks
    around the quantile, so no task holds all perplexities of a language.
    """
    held = staged(scored.where("perplexity is not null").join(fitted.unseen, "doc_id", "left_semi")
                  .select(F.explode(F.array(F.concat(F.lit("+"), F.col("lang")), F.lit(""))).alias("group"), F.col("perplexity").alias("p"))
                  .where("group is not null"))                 # the group "" has all rows
    near = [F.percentile_approx("p", min(max(quantile + s * 2 / SKETCH, 0.0), 1.0), SKETCH) for s in (-1, 1)]
    ends = held.groupBy("group").agg(F.count("*").alias("n"), near[0].alias("low"), near[1].alias("high"))
    ends = staged(ends.withColumns({c: F.when(F.col("n") > BRACKETED, F.col(c)) for c in ("low", "high")}))
    placed = held.join(F.broadcast(ends) if ends.count() <= MAX_LANGUAGES else ends, "group")
    below, beyond = F.coalesce(F.col("p") < F.col("low"), F.lit(False)), F.coalesce(F.col("p") > F.col("high"), F.lit(False))
    before = placed.groupBy("group").agg(F.count_if(below).alias("before"), F.first("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("group").orderBy("p")) - 1
    inside = placed.where(~below & ~beyond).select("group", "p", rank.alias("rank")).join(before, "group").withColumn("rank", F.col("rank") + F.col("before"))
    at = F.lit(quantile) * (F.col("n") - 1)
    value = lambda r: F.min(F.when(F.col("rank") == r(at), F.col("p")))
    q = (inside.groupBy("group").agg(F.first("n").alias("n"), value(F.floor).alias("a"), value(F.ceil).alias("b"))
         .withColumn("q", F.col("a") + (F.col("b") - F.col("a")) * (at - F.floor(at))))
    q = staged(q)
    every = q.where("group = ''").first()
    if every is None:
        return scored.sparkSession.createDataFrame([], "lang string, threshold double")
    weight = F.when(F.col("group") == "", 1).otherwise(F.col("n") / (F.col("n") + MIN_ROWS))
    shrunk = F.exp(weight * F.log("q") + (1 - weight) * F.lit(float(np.log(every["q"]))))
    return staged(q.select(F.when(F.col("group") != "", F.substring("group", 2, 1 << 30)).alias("lang"), (shrunk * margin).alias("threshold")))


def _with_limit(rows: DataFrame, limits: DataFrame, name: str) -> DataFrame:
    """Adds the column ``name``: the threshold of the row's language, or the pooled one."""
    pooled = limits.where("lang is null").first()
    own = limits.where("lang is not null").select(F.col("lang").alias(f"{name}_lang"), F.col("threshold").alias(f"{name}_own"))
    own = F.broadcast(own) if own.count() <= MAX_LANGUAGES else own
    every = F.lit(pooled["threshold"] if pooled else None).cast("double")
    return (rows.join(own, F.col("lang").cast("string") == F.col(f"{name}_lang"), "left")
            .withColumn(name, F.coalesce(f"{name}_own", every)).drop(f"{name}_lang", f"{name}_own"))


def _perplexities(rows: DataFrame, fitted: Quality, keep: list[str]) -> DataFrame:
    """``keep`` columns (the first ones) and ``perplexity``, from the last column, ``text``."""
    shared = shipped(rows.sparkSession, fitted)
    k = len(keep)

    def run(batches):
        fitted = shared()
        scores = fitted.scores()
        for b in batches:
            for i, j in releasing(text_stretches(b.column(k), STRETCH)):
                got = fitted.perplexities(b.column(k).slice(i, j - i), scores)
                yield pa.RecordBatch.from_arrays([*[b.column(c).slice(i, j - i) for c in range(k)], pa.array(got, pa.float64())], names=[*keep, "perplexity"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:k])
    return rows.mapInArrow(tidied(run), f"{schema}, perplexity double")


def _by_parts(rows: DataFrame, fitted: Quality, name: str) -> DataFrame:
    """``rows`` with their perplexities by a model in several parts, a pass for each: the rows are staged with a number, the parts' sums are
    added by it."""
    key, total, symbols = (free_name(rows.columns, c) for c in ("row", "total", "symbols"))
    rows = staged(rows.withColumn(key, F.monotonically_increasing_id()))
    sums = []
    for part in range(fitted.parts):
        shared = shipped(rows.sparkSession, fitted.of_part(part))

        def run(batches, shared=shared):
            one = shared()
            scores = one.scores()
            for b in batches:
                for i, j in releasing(text_stretches(b.column(1), STRETCH)):
                    got, n = one.sums(b.column(1).slice(i, j - i), scores)
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(got), pa.array(n)], names=[key, total, symbols])

        sums.append(staged(rows.select(key, whole_text().alias("text")).mapInArrow(tidied(run), f"`{key}` long, `{total}` double, `{symbols}` long")))
    every = reduce(DataFrame.unionAll, sums).groupBy(key).agg(F.sum(total).alias(total), F.max(symbols).alias(symbols))
    value = F.when(F.col(symbols) > 0, F.exp(-F.col(total) / F.col(symbols)))
    return rows.join(every.select(key, value.alias(name)), key).drop(key)


def classify(docs: DataFrame, fitted: Quality) -> DataFrame:
    """``(doc_id, lang, perplexity, threshold, kept)`` of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), whole_text().alias("text"))
    if fitted.model is None:
        return rows.select("doc_id", "lang", F.lit(None).cast("double").alias("perplexity"), F.lit(None).cast("double").alias("threshold"), F.lit(True).alias("kept"))
    if fitted.parts > 1:
        scored = staged(_by_parts(rows, fitted, "perplexity").drop("text"))
    else:
        scored = staged(_perplexities(rows, fitted, ["doc_id", "lang"]))
    return (_with_limit(scored, thresholds(scored, fitted), "threshold")
            .withColumn("kept", ~F.coalesce(F.col("perplexity") > F.col("threshold"), F.lit(False))))


def keep_good(docs: DataFrame, fitted: Quality) -> DataFrame:
    """``docs`` without the rejected rows; all columns as they are.  Every text is scored once: the rows are written with their
    perplexity, the thresholds come from the narrow columns."""
    if fitted.model is None:
        return docs
    shared = shipped(docs.sparkSession, fitted)
    at, name = docs.columns.index("text"), "perplexity"
    while any(c.lower().startswith(name) for c in docs.columns):
        name = f"_{name}"

    def run(batches):
        fitted = shared()
        scores = fitted.scores()
        for b in batches:
            for i, j in releasing(text_stretches(b.column(at), STRETCH)):
                part = b.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(fitted.perplexities(part.column(at), scores), pa.float64())], names=[*part.schema.names, name])

    if fitted.parts > 1:
        kept = staged(_by_parts(docs, fitted, name))
    else:
        kept = staged(docs.mapInArrow(tidied(run), T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])))
    narrow = kept.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col(name).alias("perplexity"))
    judged = _with_limit(kept, thresholds(narrow, fitted), f"{name}_limit")
    return judged.where(~F.coalesce(F.col(name) > F.col(f"{name}_limit"), F.lit(False))).select(*docs.columns)
