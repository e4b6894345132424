"""Byte n-gram models that run across blanks, with Kneser-Ney smoothing: counting and scoring.

A text is its words (runs of bytes other than ASCII blanks), each closed by one blank, after zero bytes.  An n-gram key packs
the ``order`` bytes that end at a byte, so keys are exact integers.  The first ``order - 1`` bytes of a word see bytes of the words
before it, the others only their own word: a word's score is that of its head (with the bytes before it) and that of its rest.
Equal heads and equal words have equal parts: a worker scores each new one once and remembers a bounded number.  Texts are cut, and heads packed into
whole numbers, by array operations over a stretch of texts.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rubricon.llm.chunks import places_of_none, text_stretches
from rubricon.llm.common import releasing, tidied

COUNTED = 2_000_000             # bytes of text counted together


def heads_of(words: list[bytes], order: int) -> list[bytes]:
    """For each word its first ``order - 1`` bytes (with the closing blank, if among them) after the ``order - 1`` bytes before it."""
    k = order - 1
    blob = bytes(k) + b" ".join(words) + b" "
    ends = accumulate([len(w) + 1 for w in words], initial=k)
    return [blob[s - k:s + min(k, len(w) + 1)] for s, w in zip(ends, words, strict=False)]


def head_alone(word: bytes, order: int) -> bytes:
    """The head of a word without words before it."""
    return bytes(order - 1) + (word + b" ")[:order - 1]


def rest_of(word: bytes, order: int) -> bytes:
    """The piece whose n-grams end behind the head of ``word``; empty when there are none."""
    return word + b" " if len(word) >= order - 1 else b""


def keys_of(pieces: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram keys that lie within the pieces, one piece after the other, and where each piece's keys begin."""
    blob = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int64)
    key = np.zeros(len(blob) - order + 1, np.int64)
    for j in range(order):
        key |= blob[j:len(blob) - order + 1 + j] << (8 * (order - 1 - j))
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    starts, lengths = np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes - (order - 1)
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    take = np.repeat(starts - first, lengths) + np.arange(lengths.sum())
    return key[take], first


LOWER = np.arange(256, dtype=np.uint8) + 32 * ((np.arange(256) >= 65) & (np.arange(256) <= 90)).astype(np.uint8)


class Words:
    """The words of texts as arrays, in order.

    ``text`` has the place of each word's text, ``size`` its bytes, ``code`` its place among the ``distinct`` ones and ``head`` the bytes of its head as
    one number (zero bytes behind a short one).  ``lower``: A-Z in lower case.  ``once``: words that repeat the one before are left out and counted in ``same``.
    """

    def __init__(self, texts, order: int, lower: bool = False, once: bool = False):
        texts = (texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())).fill_null("")
        k, self.n = order - 1, len(texts)
        if 2 * k > 8:
            raise ValueError("a head of more than eight bytes")
        offsets = np.frombuffer(texts.buffers()[1] or bytes(4), np.int32)[texts.offset:texts.offset + self.n + 1].astype(np.int64)
        data, edges = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]], offsets - offsets[0]
        data = LOWER[data] if lower else data
        solid = (data != 32) & ((data < 9) | (data > 13))
        within = edges[(edges > 0) & (edges < len(data))]
        begins, ends = solid.copy(), solid.copy()
        begins[1:] &= ~solid[:-1]
        begins[within] = solid[within]
        ends[:-1] &= ~solid[1:]
        ends[within - 1] = solid[within - 1]
        start = np.flatnonzero(begins)
        size = np.flatnonzero(ends) + 1 - start
        text = np.searchsorted(edges, start, "right") - 1
        letters = data[solid]
        bounds = np.concatenate([[0], np.cumsum(size)])
        words = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(bounds.astype(np.int32).tobytes()), pa.py_buffer(letters.tobytes())])
        coded = words.dictionary_encode()
        code = coded.indices.to_numpy()
        self.distinct: list[bytes] = coded.dictionary.to_pylist()
        self.same = np.zeros(self.n, np.int64)
        if once:
            keep = np.ones(len(size), bool)
            keep[1:] = (code[1:] != code[:-1]) | (text[1:] != text[:-1])
            self.same = np.bincount(text[~keep], minlength=self.n)
            letters = letters[np.repeat(keep, size)]
            size, text, code = size[keep], text[keep], code[keep]
        self.text, self.size, self.code = text, size, code
        before = np.cumsum(size) - size                             # letters before each word
        firsts = np.cumsum(np.diff(text, prepend=-1) > 0)           # texts up to it
        at = before + np.arange(len(size)) + k * firsts             # words and blanks, after k zero bytes for each text
        run = np.zeros(len(letters) + len(size) + k * (self.n + 2), np.uint8)
        run[np.repeat(at - before, size) + np.arange(len(letters))] = letters
        run[at + size] = 32
        self.head = np.zeros(len(size), np.int64)
        for j in range(-k, k):
            self.head = (self.head << 8) | np.where(j <= size, run[at + j], 0)


def grams_of_heads(heads: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """For each head the keys of its ``order - 1`` n-grams, and which of them it has."""
    k = order - 1
    shifts = 8 * np.arange(k - 1, -1, -1)
    keys = (heads[:, None] >> shifts) & ((1 << (8 * order)) - 1)
    inner = ((heads[:, None] >> shifts) & 255) == 32                # the word ends here
    return keys, np.cumsum(inner, axis=1) - inner == 0


def count_grams(texts: DataFrame, order: int, classes: int = 1, alone: bool = False, lower: bool = False, once: bool = False) -> DataFrame:
    """``(key, c0, c1, ...)``: how often each n-gram occurs in the texts of each class, cut into ``Words``.

    With ``alone`` the heads are also counted as if their words were texts of their own.  ``texts`` has ``(text, cls)``; every stretch is counted in the task before anything is shuffled.
    """
    names = [f"c{k}" for k in range(classes)]

    def counted(texts):
        words = Words(texts, order, lower, once)
        heads, n = np.unique(words.head, return_counts=True)
        keys, real = grams_of_heads(heads, order)
        found = [(keys[real], np.repeat(n, real.sum(1)))]
        n = np.bincount(words.code, minlength=len(words.distinct))
        for piece_of in [rest_of] + ([head_alone] if alone else []):
            pieces = [piece_of(w, order) for w in words.distinct]
            whole = [p for p in pieces if p]
            if whole:
                keys, first = keys_of(whole, order)
                found.append((keys, np.repeat(n[[len(p) > 0 for p in pieces]], np.diff(np.append(first, len(keys))))))
        distinct, at = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
        return distinct, np.bincount(at, np.concatenate([f[1] for f in found]), len(distinct)).astype(np.int64)

    def run(batches):
        for b in batches:
            for i, j in releasing(text_stretches(b.column(0), COUNTED)):
                text, cls = b.column(0).slice(i, j - i), b.column(1).slice(i, j - i).to_numpy()
                for k in range(classes):
                    keys, n = counted(text.filter(pa.array(cls == k)))
                    if len(keys):
                        none = np.zeros(len(keys), np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(keys), *[pa.array(n if c == k else none) for c in range(classes)]], names=["key", *names])

    schema = ", ".join(["key long", *[f"{n} long" for n in names]])
    return texts.select("text", "cls").mapInArrow(tidied(run), schema).groupBy("key").agg(*[F.sum(n).alias(n) for n in names])


def discounts(counts: DataFrame, col: str, modified: bool) -> list[float]:
    """Kneser-Ney discounts for counts of 1, 2 and 3 or more (one and the same unless ``modified``)."""
    r = counts.agg(*[F.sum((F.col(col) == k).cast("long")).alias(f"n{k}") for k in (1, 2, 3, 4)]).first()
    n1, n2, n3, n4 = (float(r[f"n{k}"] or 0) for k in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    if not modified or not (n3 and n4):
        return [y, y, y]
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return [min(max(v, 0.05), k + 0.95) for k, v in enumerate(d)]


def smoothed(counts: DataFrame, col: str, modified: bool) -> DataFrame:
    """``(key, alpha, ctx, gamma)`` of one order: the discounted share of an n-gram in its context, and
    the context's weight for the next lower order.  Context totals are joined to their n-grams by the
    context's key, so the count table is sharded over all tasks."""
    d = discounts(counts, col, modified)
    off = F.when(F.col(col) == 1, d[0]).when(F.col(col) == 2, d[1]).when(F.col(col) > 2, d[2]).otherwise(0.0)
    own = counts.where(F.col(col) > 0).select("key", F.col(col).alias("c"), off.alias("off"), F.shiftright("key", 8).alias("ctx"))
    total = own.groupBy("ctx").agg(F.sum("c").alias("total"), F.sum("off").alias("freed"))
    return own.join(total, "ctx").select("key", ((F.col("c") - F.col("off")) / F.col("total")).alias("alpha"), "ctx",
                                         (F.col("freed") / F.col("total")).alias("gamma"))


def lower_order(counts: DataFrame, col: str, order: int) -> DataFrame:
    """Continuation counts of the next lower order: how many distinct bytes precede an n-gram."""
    mask = (1 << (8 * (order - 1))) - 1
    return (counts.where(F.col(col) > 0).groupBy(F.col("key").bitwiseAND(F.lit(mask)).alias("key"))
            .agg(F.count("*").alias(col)))


class Level:
    """One order of a model as sorted arrays (its size is bounded by the training sample)."""

    def __init__(self, table: DataFrame):
        got = table.toArrow()
        key = got["key"].to_numpy()
        by = np.argsort(key)
        self.key, self.alpha = key[by], got["alpha"].to_numpy()[by].astype(np.float32)
        ctx, at = np.unique(got["ctx"].to_numpy(), return_index=True)
        self.ctx, self.gamma = ctx, got["gamma"].to_numpy()[at].astype(np.float32)

    @staticmethod
    def _find(sorted_keys, values, wanted, default):
        if not len(sorted_keys):
            return np.full(len(wanted), default)
        at = np.minimum(np.searchsorted(sorted_keys, wanted), len(sorted_keys) - 1)
        return np.where(sorted_keys[at] == wanted, values[at], default)

    def mix(self, key: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """``alpha + gamma * lower``; an unseen context leaves ``lower``."""
        return (self._find(self.key, self.alpha, key, 0.0)
                + self._find(self.ctx, self.gamma, key >> 8, 1.0) * lower)


class Model:
    """Interpolated Kneser-Ney over levels 1 to ``order``; below them every byte is equally likely."""

    def __init__(self, levels: list[Level]):
        self.levels, self.order = levels, len(levels)

    def prob(self, keys: np.ndarray) -> np.ndarray:
        p = np.full(len(keys), 1.0 / 256)
        for k, level in enumerate(self.levels, 1):
            p = level.mix(keys & ((1 << (8 * k)) - 1), p)
        return p


def tables(counts: DataFrame, col: str, order: int, modified: bool) -> list[DataFrame]:
    """``smoothed`` of each order from 1 to ``order``."""
    out, table = [], counts.select("key", col)
    for k in range(order, 0, -1):
        out.append(smoothed(table, col, modified))
        if k > 1:
            table = lower_order(table, col, k)
    return out[::-1]


def fit(counts: DataFrame, col: str, order: int, modified: bool) -> Model:
    return Model([Level(t) for t in tables(counts, col, order, modified)])


def part_of(key, parts: int):
    """The part of a model that scores an n-gram (a whole number, an array or a Spark column), by the two bytes before its last one: all that
    ``prob`` looks up for the n-gram from order 3 on, contexts too, has the same two bytes there."""
    if isinstance(key, Column):
        return F.pmod((F.shiftright(key, 8).bitwiseAND(0xFFFF) * 40503).bitwiseAND(0xFFFF), F.lit(parts))
    return (((key >> 8) & 0xFFFF) * 40503 & 0xFFFF) % parts


def fit_part(levels: list[DataFrame], part: int, parts: int) -> Model:
    """One part of the model of ``tables``; the orders 1 and 2 (at most 65,536 n-grams) are whole in each."""
    return Model([Level(t if k < 3 else t.where(part_of(F.col("key"), parts) == part)) for k, t in enumerate(levels, 1)])


class PieceScores:
    """Scores of pieces from ``score_keys(keys) -> value of each key``; a bounded table remembers them."""

    def __init__(self, order: int, score_keys, remembered: int):
        self.order, self.score_keys, self.remembered, self.seen = order, score_keys, remembered, {}

    def learn(self, new: list[bytes], pieces: list[bytes]) -> None:
        if len(self.seen) + len(new) > self.remembered:
            self.seen = {}
        for i in range(0, len(new), 200_000):
            part, names = pieces[i:i + 200_000], new[i:i + 200_000]
            whole = [p for p in part if p]
            if whole:
                keys, first = keys_of(whole, self.order)
                distinct, at = np.unique(keys, return_inverse=True)
                value = iter(np.add.reduceat(self.score_keys(distinct)[at], first).tolist())
            self.seen.update((n, next(value) if p else 0.0) for n, p in zip(names, part, strict=True))

    def of(self, names: list[bytes], piece_of) -> np.ndarray:
        """The scores of the distinct ``names``; those that are new are scored together."""
        got = list(map(self.seen.get, names))
        places = places_of_none(got)
        if places:
            new = [names[i] for i in places]
            self.learn(new, [piece_of(n) for n in new])
            for i, n in zip(places, new, strict=True):
                got[i] = self.seen[n]
        return np.array(got, float)


class HeadScores:
    """Scores of heads from ``score_keys(keys) -> value of each key``; a bounded sorted table remembers them."""

    def __init__(self, order: int, score_keys, remembered: int):
        self.order, self.score_keys, self.remembered = order, score_keys, remembered
        self.known, self.value = np.zeros(0, np.int64), np.zeros(0)

    def _score(self, heads: np.ndarray) -> np.ndarray:
        out = np.zeros(len(heads))
        for i in range(0, len(heads), 100_000):
            keys, real = grams_of_heads(heads[i:i + 100_000], self.order)
            distinct, at = np.unique(keys[real], return_inverse=True)
            each = np.zeros(keys.shape)
            each[real] = self.score_keys(distinct)[at]
            out[i:i + 100_000] = each.sum(1)
        return out

    def of(self, heads: np.ndarray) -> np.ndarray:
        coded = pa.array(heads).dictionary_encode()
        distinct = np.sort(coded.dictionary.to_numpy())
        at = np.searchsorted(self.known, distinct)
        new = np.ones(len(distinct), bool)
        if len(self.known):
            new = self.known[np.minimum(at, len(self.known) - 1)] != distinct
        value = np.zeros(len(distinct))
        value[~new] = self.value[at[~new]]
        if new.any():
            value[new] = self._score(distinct[new])
            if len(self.known) + new.sum() > self.remembered:
                self.known, self.value = distinct, value
            else:
                self.known, self.value = np.insert(self.known, at[new], distinct[new]), np.insert(self.value, at[new], value[new])
        place = np.searchsorted(distinct, coded.dictionary.to_numpy())
        return value[place][coded.indices.to_numpy()]


class WordScores:
    """Scores of words in their texts: head and rest."""

    def __init__(self, order: int, score_keys, remembered: int = 200_000):
        self.order = order
        self.heads, self.rests = HeadScores(order, score_keys, 5 * remembered), PieceScores(order, score_keys, remembered)
        self.words = PieceScores(order, score_keys, remembered)

    def of(self, words: Words) -> np.ndarray:
        return self.heads.of(words.head) + self.rests.of(words.distinct, lambda w: rest_of(w, self.order))[words.code]

    def alone(self, words: Words) -> np.ndarray:
        """The scores of the words as if each were a text of its own."""
        return self.words.of(words.distinct, lambda w: bytes(self.order - 1) + w + b" ")[words.code]
