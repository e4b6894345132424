"""Packing token sequences: non-negative least squares over length combinations.

Every document becomes its token ids and an end id.  A document longer than the window is cut
at multiples of the window; so all its pieces but the last fill a window alone.  Piece
lengths are rounded up to classes of ``unit`` tokens, and the histogram of classes is all
the driver sees (a fixed number of rows).  There:

1. Shallow combinations of up to ``depth`` classes that fill a window exactly are enumerated.
2. Non-negative least squares finds repeat counts whose sum of combinations comes closest to the
   histogram (active-set method: its solution uses at most as many combinations as classes).
3. Counts are rounded down, and what the histogram has left is packed greedily, largest class
   first, in patterns with multiplicities.

The plan is a bounded table of runs: "pieces number ``lo`` to ``hi`` of this class take this slot of the
sequences from ``base`` on".  Pieces get their number within a class from a per-partition counter
and per-partition totals, so no class is gathered in one task, and a broadcast of the
bounded plan turns numbers into sequences.

Defined results: null text is the empty text (only the end id); repeated rows are packed as often as
they occur; an empty table gives an empty result; null ids stay null.
"""

from __future__ import annotations

import zlib
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rubricon.llm.chunks import encoder, text_stretches
from rubricon.llm.common import id_and_text, staged, tidied

WINDOW = 2048
UNIT = 4
DEPTH = 3
END_ID = 1
STRETCH = 1_500_000             # bytes of text encoded together


def cut_tokens(docs: DataFrame, vocabulary: str, window: int = WINDOW, unit: int = UNIT, end_id: int = END_ID) -> DataFrame:
    """Pieces ``(doc_id, start, length, ids, ids_crc32, doc_tokens, cls, num)``: ``ids`` are the piece's ids as
    little-endian unsigned 32-bit integers, ``num`` counts the pieces of a class within a partition."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        enc = encoder(vocabulary, False, False)
        seen = np.zeros(-(-window // unit) + 1, np.int64)
        for b in batches:
            texts, doc_ids = b.column(1), b.column(0).to_pylist()
            for i, j in text_stretches(texts, STRETCH):
                rows = []
                for doc_id, found in zip(doc_ids[i:j], enc.encode(texts.slice(i, j - i)), strict=True):
                    ids = found.tobytes() + end
                    total = len(ids) // 4
                    for start in range(0, total, window):
                        piece = ids[4 * start:4 * (start + window)]
                        n = len(piece) // 4
                        cls = -(-n // unit)
                        rows.append((doc_id, start, n, piece, zlib.crc32(piece), total, cls, int(seen[cls])))
                        seen[cls] += 1
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[k], t) for k, t in enumerate(schema.types)], schema=schema)

    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
                        ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("cls", pa.int32()), ("num", pa.int64())])
    return id_and_text(docs).mapInArrow(
        tidied(run), "doc_id long, start long, length long, ids binary, ids_crc32 long, doc_tokens long, cls int, num long")


def combinations_filling(classes: int, depth: int) -> np.ndarray:
    """All multisets of up to ``depth`` (1 to 3) classes 1..classes that sum to ``classes``; padded with 0."""
    rows = [(classes, 0, 0)]
    if depth >= 2:
        rows += [(a, classes - a, 0) for a in range(1, classes // 2 + 1)]
    if depth >= 3:
        for a in range(1, classes // 3 + 1):
            rows += [(a, b, classes - a - b) for b in range(a, (classes - a) // 2 + 1)]
    return np.array(rows, np.int64)


def nnls(cols: np.ndarray, target: np.ndarray, rounds: int, tolerance: float = 1e-3) -> np.ndarray:
    """Non-negative least squares by active sets.  ``cols`` lists the rows that a column adds one to
    (row 0 is a dummy); ``rounds`` and ``tolerance`` only end the search early: what is left over is packed greedily."""
    n = len(target)
    x = np.zeros(len(cols))
    chosen: list[int] = []
    dense = lambda js: sum(np.eye(n)[cols[js, k]].T * (cols[js, k] > 0) for k in range(cols.shape[1]))
    scale = max(1.0, float(target.max(initial=0)))
    size = np.sqrt((cols > 0).sum(1))
    for _ in range(rounds):
        left = target - np.bincount(cols[chosen].ravel(), np.repeat(x[chosen], cols.shape[1]), n) if chosen else target.astype(float)
        left[0] = 0
        gain = left[cols].sum(1) / size
        gain[chosen] = -np.inf
        j = int(gain.argmax())
        if gain[j] <= tolerance * scale:
            break
        chosen.append(j)
        while True:
            a = dense(chosen)
            s = np.linalg.solve(a.T @ a + 1e-9 * np.eye(len(chosen)), a.T @ target)
            if (s > 0).all():
                x[chosen] = s
                break
            old = x[chosen]
            neg = s <= 0
            with np.errstate(divide="ignore", invalid="ignore"):
                step = np.where(neg, old / (old - s), np.inf).min()
            new = old + (0 if not np.isfinite(step) else step) * (s - old)
            x[chosen] = 0
            keep = [(c, v) for c, v, bad in zip(chosen, new, neg, strict=True) if v > 1e-9 and not (bad and v <= 1e-9)]
            chosen = [c for c, _ in keep]
            x[chosen] = [v for _, v in keep]
            if not chosen:
                break
    return x


def plan(counts: np.ndarray, depth: int = DEPTH) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of classes and how often each is used; ``counts[c]`` pieces of class ``c``, window = last class."""
    classes = len(counts) - 1
    left = counts.astype(np.int64).copy()
    left[0] = 0
    cols = combinations_filling(classes, depth)
    cols = cols[(left[cols] > 0).sum(1) == (cols > 0).sum(1)]
    out: list[tuple[tuple[int, ...], int]] = []

    def use(pattern: tuple[int, ...], times: int) -> None:
        need = np.bincount(pattern, minlength=classes + 1)
        times = int(min(times, (left[need > 0] // need[need > 0]).min()))
        if times > 0:
            left[:] -= times * need
            out.append((pattern, times))

    if len(cols):
        x = nnls(cols, left.astype(float), rounds=2 * classes)
        for j in np.argsort(-x):
            if x[j] < 1:
                break
            use(tuple(int(c) for c in cols[j] if c), int(x[j]))
    while left.any():
        space, pattern, rest = classes, [], left.copy()
        while space and (fit := np.flatnonzero(rest[:space + 1])).size:
            c = int(fit[-1])
            k = int(min(rest[c], space // c))
            pattern += [c] * k
            rest[c] -= k
            space -= c * k
        use(tuple(pattern), int(left.max()))
    return out


def runs(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """``(cls, lo, hi, base, slot)``: pieces ``lo <= n < hi`` of a class go to sequence ``base + n - lo``."""
    used: dict[int, int] = {}
    out, base = [], 0
    for pattern, times in patterns:
        for slot, c in enumerate(pattern):
            lo = used.get(c, 0)
            used[c] = lo + times
            out.append((c, lo, lo + times, base, slot))
        base += times
    return out


def pack(docs: DataFrame, vocabulary: str, window: int = WINDOW, unit: int = UNIT, depth: int = DEPTH,
         end_id: int = END_ID) -> DataFrame:
    """Pieces with their place: ``(doc_id, start, length, ids, ids_crc32, doc_tokens, sequence_id, offset, sequence_tokens,
    padded_tokens)``; ``padded_tokens`` is the window, or the sequence's own length where that is a power of two."""
    spark = docs.sparkSession
    pieces = staged(cut_tokens(docs, vocabulary, window, unit, end_id)
                    .withColumn("piece", F.monotonically_increasing_id()))
    part = F.shiftright("piece", 33).alias("part")
    narrow = pieces.select("piece", part, "cls", "num", "length")
    cells = narrow.groupBy("cls", "part").agg(F.count("*").alias("n"))
    cells = staged(cells)
    counts = np.zeros(-(-window // unit) + 1, np.int64)
    for r in cells.groupBy("cls").agg(F.sum("n").alias("n")).collect():      # at most window / unit rows
        counts[r["cls"]] = r["n"]
    table = spark.createDataFrame(runs(plan(counts, depth)), "cls int, lo long, hi long, base long, slot int")
    before = Window.partitionBy("cls").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = cells.select("cls", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    numbered = narrow.join(first, ["cls", "part"]).select("piece", "cls", "length", (F.col("first") + F.col("num")).alias("n"))
    # the plan has a bounded number of rows: classes, combinations and greedy patterns do not grow with the data
    placed = (numbered.join(F.broadcast(table), "cls").where("n >= lo and n < hi")
              .select("piece", "length", "slot", (F.col("base") + F.col("n") - F.col("lo")).alias("sequence_id")))
    inside = Window.partitionBy("sequence_id").orderBy("slot")
    total = F.sum("length").over(Window.partitionBy("sequence_id"))
    placed = placed.select("piece", "sequence_id", (F.sum("length").over(inside) - F.col("length")).alias("offset"),
                           total.alias("sequence_tokens"))
    out = pieces.join(placed, "piece")
    is_power = F.col("sequence_tokens").bitwiseAND(F.col("sequence_tokens") - 1) == 0
    return out.select("doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_tokens",
                      F.when(is_power, F.col("sequence_tokens")).otherwise(F.lit(window).cast("long")).alias("padded_tokens"))
