"""Toxicity by class-conditional Kneser-Ney models.

Two models of the bytes of words and of the bytes before them across the blank, one fitted on toxic and one on ordinary labelled texts, share all their
backoff counts: each interpolates its own highest-order counts with one Kneser-Ney model of both classes
together.  A rare expression that neither class has seen therefore gets the same probability from both.  A word's
score is the difference of its two log-likelihoods, alone and where it stands.  A document is described by differences that are normalised
by length: the mean over all its words, the means over its most toxic words (one, three and ten), and the
means of what exceeds the levels ``CLEAR``; a logistic curve, fitted on labelled rows that no count has seen, turns
them into a score between 0 and 1.  Differences of words where they stand are part of the curve, and computed at all, only if they raise the
likelihood of those rows by ``GAIN``, that is, if expressions of several words tell more than their words do.

The labelled sample is bounded: the ``max_rows`` learnable rows with the smallest hashed ids.  So the model
is bounded too and is broadcast.  Nothing but the text is an input of a score.

Defined results: null and empty texts are texts without words (differences 0) and are scored; rows with null labels or
ids teach nothing; of repeated label rows any is as good as the other (each counts); an empty table gives an empty
result; without a labelled row of either class every score is the share of toxic ones (0 without any).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rubricon.llm.chunks import text_stretches
from rubricon.llm.common import crc_fold, id_and_text, releasing, shipped, staged, tidied
from rubricon.llm.wordgrams import Level, Words, WordScores, count_grams, fit, smoothed

ORDER = 5
TOPS = (1, 3, 10)
CLEAR = (2.0, 4.0)
KIND = 1 + len(TOPS) + len(CLEAR)       # numbers for each kind of score
GAIN = 0.15                     # share of the log-likelihood that the second kind must win: it costs more than twice the first
MAX_ROWS = 20_000
THRESHOLD = 0.3
STRETCH = 1_200_000             # bytes of text scored together


def features(texts, scores: WordScores, in_place: bool = True) -> np.ndarray:
    """The differences of each text, of its words each alone and, if asked for, of its words where they stand."""
    words = Words(texts, ORDER, lower=True)
    kinds = [scores.alone(words)] + ([scores.of(words)] if in_place else [])
    out = np.zeros((words.n, KIND * len(kinds)))
    n = np.bincount(words.text, minlength=words.n)
    ends = np.cumsum(n)
    mean = lambda x: np.bincount(words.text, x, words.n) / np.maximum(n, 1)
    for k, each in enumerate(kinds):
        most = np.zeros((words.n, max(TOPS)))
        for i in np.flatnonzero(n).tolist():
            x = each[ends[i] - n[i]:ends[i]]
            top = np.sort(np.partition(x, len(x) - most.shape[1])[-most.shape[1]:] if len(x) > most.shape[1] else x)[::-1]
            most[i, :len(top)] = top
        out[:, KIND * k:KIND * (k + 1)] = np.column_stack([mean(each), *[most[:, :t].sum(1) / t for t in TOPS], *[mean(np.maximum(each - c, 0)) for c in CLEAR]])
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Weights and intercept of a ridge logistic regression by Newton's method."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    w[-1] = np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))
    keep = np.r_[np.full(x.shape[1], ridge * len(x) / 100), 1e-9]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -35, 35)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(keep + 1e-9), z.T @ (p - y) + keep * w)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return np.r_[w[:-1] / scale, w[-1] - (w[:-1] / scale) @ mean]


def fit_rising(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """As ``fit_logistic`` with no negative weight: a larger difference never lowers the score."""
    use = np.ones(x.shape[1], bool)
    while True:
        w = fit_logistic(x[:, use], y)
        out = np.zeros(x.shape[1] + 1)
        out[:-1][use], out[-1] = w[:-1], w[-1]
        if (out[:-1] >= 0).all() or use.sum() == 1:
            return out
        use[np.argmin(out[:-1])] = False


def log_likelihood(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    z = np.clip(x @ w[:-1] + w[-1], -35, 35)
    return float((y * z - np.logaddexp(0, z)).sum())


def fit_curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The curve of the first kind of scores, or of both if the second is worth it."""
    alone, both = fit_rising(x[:, :KIND], y), fit_rising(x, y)
    worth = log_likelihood(x, y, both) > (1 - GAIN) * log_likelihood(x[:, :KIND], y, alone)
    return both if worth else alone


class Toxicity:
    """The fitted model; picklable, bounded by the labelled sample."""

    def __init__(self, shared=None, toxic=None, ordinary=None, weights=None, share=0.0):
        self.shared, self.toxic, self.ordinary, self.weights, self.share = shared, toxic, ordinary, weights, share

    def differences(self, keys: np.ndarray) -> np.ndarray:
        below = self.shared.prob(keys)
        return np.log(self.toxic.mix(keys, below)) - np.log(self.ordinary.mix(keys, below))

    def words(self) -> WordScores | None:
        return WordScores(ORDER, self.differences) if self.shared is not None else None

    def score(self, texts, scores: WordScores | None) -> np.ndarray:
        if scores is None:
            return np.full(len(texts), self.share)
        z = features(texts, scores, len(self.weights) > KIND + 1) @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def _models(rows: DataFrame) -> Toxicity:
    counts = staged(count_grams(rows, ORDER, 2, alone=True, lower=True).withColumn("both", F.col("c0") + F.col("c1")))
    return Toxicity(fit(counts, "both", ORDER, False), Level(smoothed(counts, "c1", False)), Level(smoothed(counts, "c0", False)))


def train(docs: DataFrame, labels: DataFrame, learnable, max_rows: int = MAX_ROWS) -> Toxicity:
    """Fits on labelled rows for which the column ``learnable`` holds.  Counts come from three quarters of the
    sample, the logistic curve from the rest (by another hash of the id)."""
    known = (labels.where("doc_id is not null and toxic is not null").where(learnable)
             .select("doc_id", (F.col("toxic") > 0).cast("int").alias("cls"), F.xxhash64("doc_id").alias("h")))
    sample = known.orderBy("h", "doc_id", "cls").limit(max_rows)         # the bounded sample
    fold = F.pmod(F.shiftright("h", 20), F.lit(4))
    rows = staged(id_and_text(docs).join(F.broadcast(sample), "doc_id").select("text", "cls", fold.alias("fold")))
    by_class = {r["cls"]: r["n"] for r in rows.groupBy("cls").agg(F.count("*").alias("n")).collect()}
    n = sum(by_class.values())
    if len(by_class) < 2:
        return Toxicity(share=by_class.get(1, 0) / n if n else 0.0)
    model = _models(rows.where("fold > 0"))
    shared = shipped(docs.sparkSession, model)

    def describe(batches):
        scores = shared().words()
        for b in batches:
            for i, j in releasing(text_stretches(b.column(0), STRETCH)):
                got = features(b.column(0).slice(i, j - i), scores).tolist()
                yield pa.record_batch([pa.array(got, pa.list_(pa.float64())), b.column(1).slice(i, j - i)], names=["x", "cls"])

    held = rows.where("fold = 0").select("text", "cls").mapInArrow(tidied(describe), "x array<double>, cls int").toPandas()
    if held["cls"].nunique() == 2:
        model.weights = fit_curve(np.array(held["x"].tolist()), held["cls"].to_numpy(float))
    else:                                                   # too few rows to fit a curve
        model.weights = np.array([0.0, *[float(t == 3) for t in TOPS], *[0.0] * len(CLEAR), -6.0])
    final = _models(rows)                                   # the curve is fitted; counts now come from all rows
    final.weights = model.weights
    return final


def score(docs: DataFrame, model: Toxicity) -> DataFrame:
    """``(doc_id, score)`` of every row."""
    shared = shipped(docs.sparkSession, model)

    def run(batches):
        model = shared()
        scores = model.words()
        for b in batches:
            for i, j in releasing(text_stretches(b.column(1), STRETCH)):
                texts = b.column(1).slice(i, j - i)
                yield pa.record_batch([b.column(0).slice(i, j - i), pa.array(model.score(texts, scores))], names=["doc_id", "score"])

    return id_and_text(docs).mapInArrow(tidied(run), "doc_id long, score double")


def keep_ordinary(docs: DataFrame, model: Toxicity, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more; all columns as they are."""
    shared = shipped(docs.sparkSession, model)
    at = docs.columns.index("text")

    def run(batches):
        model = shared()
        scores = model.words()
        for b in batches:
            for i, j in releasing(text_stretches(b.column(at), STRETCH)):
                texts = b.column(at).slice(i, j - i)
                yield b.slice(i, j - i).filter(pa.array(model.score(texts, scores) < threshold))

    return docs.mapInArrow(tidied(run), docs.schema)


def held_out(mod: int = 4, remainder: int = 2):
    return crc_fold("doc_id", mod) == remainder
