"""Embedding whitening by mixed-precision refinement of the eigenvectors.

Entries become whole numbers ``floor(256 c)``; every distinct vector of these counts once.  Sums are exact; the covariance is summed over
the partitions from centred vectors, one ``d x d`` partial for each, merged row by row.  The driver holds that one matrix
(its size depends on the vectors' length, never on their number): eigenvectors in float32 are corrected in extended precision by
Ogita and Aishima's iteration, which only multiplies matrices.  Eigenvalues closer to each other than the current error are
a cluster, which the iteration can't separate: its small shifted block is solved by itself and turns its vectors.

Defined results: vectors that are null, or hold null, non-finite or entries whose whole number does not fit into a long, are dropped;
repeated rows stay rows but count once in the fit; null ids are kept; vectors of different lengths are fitted apart, each length on
its own; vectors without entries have no components and no rows; a deviation beyond a long is null; where the covariance has no spread along a
component (its eigenvalue vanishes in double precision) ``whitened`` is null and the component does not count in ``identity_error``, and
``explained`` is null if there is no spread at all; an empty table has no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rubricon.llm.common import shipped, staged

COMPONENTS = 4
SCALE = 256
SAFE = 2 ** 62                        # whole-number products below this can't leave a long
MAX_LENGTH = 4096                     # the correction takes time with the cube of the length: minutes on the driver here
SLICES = 4                            # parts of an extended-precision matrix, each multiplied exactly in double precision


def whole(col: str = "embedding"):
    """The vector in whole numbers; null where the row is to be dropped."""
    inside = F.forall(col, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double") * SCALE) < float(SAFE)))
    return F.when(F.coalesce(inside, F.lit(False)), F.transform(col, lambda c: F.floor(c.cast("double") * SCALE)))


def by_length(column):
    """Rows of a list column without nulls by their length: ``(length, row numbers, matrix of longs)``."""
    offsets = column.offsets.to_numpy()
    length, values = np.diff(offsets), column.flatten().to_numpy(zero_copy_only=False)
    for d in np.unique(length[length > 0]):
        at = np.flatnonzero(length == d)
        yield int(d), at, values[(offsets[at] - offsets[0])[:, None] + np.arange(d)]


def deviations(x: np.ndarray, n: int, total: list[int], top: int) -> np.ndarray:
    """``n * x - total``, exact; ``top`` is at least the largest absolute entry of ``x``."""
    if n * (top + 1) + max(map(abs, total)) < SAFE:
        return n * x - np.array(total, np.int64)
    return n * x.astype(object) - np.array(total, object)


def squares(dev: np.ndarray) -> list:
    """Row sums of squares, exact, null beyond a long."""
    if dev.dtype != object and len(dev) and dev.shape[1] * max(abs(int(dev.max())), abs(int(dev.min()))) ** 2 < SAFE:
        return (dev * dev).sum(axis=1).tolist()
    exact = (dev.astype(object) ** 2).sum(axis=1)
    return [v if v < 2 ** 63 else None for v in exact]


def sliced(m: np.ndarray, axis: int, bits: int) -> list[np.ndarray]:
    """``m`` as a sum of double matrices whose entries are small whole multiples of one unit for each row or column."""
    parts = []
    for _ in range(SLICES):
        top = np.abs(m).max(axis=axis, keepdims=True).astype(float)
        unit = np.exp2(np.ceil(np.log2(np.where(top > 0, top, 1.0))) + 1 - bits)
        part = np.rint(m / unit) * unit
        parts.append(part.astype(float))
        m = m - part
    return parts


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b`` in extended precision by exact double-precision products of slices."""
    bits = (53 - int(np.ceil(np.log2(max(a.shape[1], 2))))) // 2
    left, right = sliced(a, 1, bits), sliced(b, 0, bits)
    out = np.zeros((a.shape[0], b.shape[1]), np.longdouble)
    for order in reversed(range(SLICES)):                          # the small ones first
        for i in range(order + 1):
            out += left[i] @ right[order - i]
    return out


def refined(a: np.ndarray, rounds: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and eigenvectors of a symmetric matrix, in double precision, from those in float32."""
    d = len(a)
    size = float(np.abs(a).max()) if d else 0.0
    if size == 0.0:
        return np.zeros(d), np.eye(d)
    exact = a.astype(np.longdouble) / np.longdouble(size)
    x = np.linalg.eigh(exact.astype(np.float32))[1].astype(np.longdouble)
    eye, norm = np.eye(d, dtype=np.longdouble), np.linalg.norm(exact.astype(float))
    finest = 16 * d * np.finfo(np.longdouble).eps * norm
    for _ in range(rounds):
        r = eye - product(x.T, x)
        s = product(x.T, product(exact, x))
        r, s = (r + r.T) / 2, (s + s.T) / 2                        # so that corrections keep the vectors orthogonal
        value = np.diag(s) / (1 - np.diag(r))
        off = np.linalg.norm((s - np.diag(value)).astype(float))
        error = 2 * (off + norm * np.linalg.norm(r.astype(float)))
        gap = value[None, :] - value[:, None]
        apart = np.abs(gap) > error
        e = np.where(apart, (s + r * value[None, :]) / np.where(apart, gap, 1), r / 2)
        x = x + product(x, e)
        order = np.argsort(-value, kind="stable")
        x, value = x[:, order], value[order]
        cuts = np.flatnonzero(value[:-1] - value[1:] > error) + 1
        for cluster in np.split(np.arange(d), cuts):
            if len(cluster) > 1:                                   # sub-solve about the cluster's own middle
                part = x[:, cluster]
                block = product(part.T, product(exact, part)) - value[cluster].mean() * product(part.T, part)
                scale = np.abs(block).max()
                if scale > 0:
                    turn = np.linalg.eigh(((block + block.T) / (2 * scale)).astype(float))[1]
                    x[:, cluster] = product(part, turn[:, ::-1].astype(np.longdouble))
        if error < finest:
            break
    x = x / np.sqrt((x * x).sum(axis=0))
    value = (x * product(exact, x)).sum(axis=0)
    order = np.argsort(-value, kind="stable")
    return (value[order] * size).astype(float), x[:, order].astype(float)


class Fit:
    """What was learnt from the vectors of one length."""

    def __init__(self, n: int, total: list[int], top: int, covariance: np.ndarray | None = None, components: int = COMPONENTS):
        self.n, self.total, self.top = n, total, top
        if covariance is None:
            return
        value, vector = refined((covariance + covariance.T) / 2)
        trace = float(np.trace(covariance))
        k = min(components, len(value))
        floor = np.finfo(float).eps * len(value) * max(float(np.abs(value).max()), 0.0)
        self.spread = value[:k] > floor                     # the others vanish in double precision
        self.vectors = vector[:, :k]
        self.roots = np.sqrt(np.where(self.spread, value[:k], 1.0))
        self.explained = [max(float(v), 0.0) / trace if trace > 0 else None for v in value[:k]]
        self.identity_error: float | None = None

    def centred(self, x: np.ndarray) -> np.ndarray:
        return deviations(x, self.n, self.total, self.top).astype(float) / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.vectors / self.roots


def _summed(fit: DataFrame, describe, fits) -> dict[int, np.ndarray]:
    """Sum over all rows of the matrix that ``describe(fit of this length, vectors)`` gives for each batch, by length.

    A task keeps one matrix for each length; its rows are added up by Spark.  The result goes to the driver: one matrix for each length.
    """
    known = shipped(fit.sparkSession, fits)

    def partials(batches):
        of, sums = known(), {}
        for b in batches:
            for d, _, x in by_length(b.column(0)):
                got = describe(of[d], x)
                sums[d] = sums[d] + got if d in sums else got
        for d, matrix in sums.items():
            yield pa.record_batch([pa.array(np.full(len(matrix), d)), pa.array(np.arange(len(matrix))), pa.array(matrix.tolist(), pa.list_(pa.float64()))],
                                  names=["d", "i", "row"])

    rows = (fit.select("x").mapInArrow(partials, "d long, i long, row array<double>").groupBy("d", "i")
            .agg(Summarizer.sum(array_to_vector("row")).alias("row")).select("d", "i", vector_to_array("row").alias("row")).collect())
    out: dict[int, list] = {}
    for r in sorted(rows, key=lambda r: (r["d"], r["i"])):
        out.setdefault(r["d"], []).append(r["row"])
    return {d: np.array(m) for d, m in out.items()}


def fit_list(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """Every distinct vector of whole numbers once: ``(x)``."""
    return staged(vectors.select(whole(column).alias("x")).where("x is not null and size(x) > 0").distinct())


def learn(fit: DataFrame, components: int = COMPONENTS) -> dict[int, Fit]:
    """Fits the distinct vectors of each length."""

    def totals(batches):
        sums: dict[int, list] = {}
        for b in batches:
            for d, _, x in by_length(b.column(0)):
                high, low = x >> 31, x & (2 ** 31 - 1)                      # halves whose sums fit
                top = np.maximum(x.max(axis=0), -x.min(axis=0))
                n, h, lo, t = sums.get(d, (0, 0, 0, 0))
                sums[d] = (n + len(x), h + high.sum(axis=0), lo + low.sum(axis=0), np.maximum(t, top))
        for d, (n, h, lo, t) in sums.items():
            yield pa.record_batch([pa.array(np.full(d, v)) if np.isscalar(v) else pa.array(v) for v in (d, n)] + [pa.array(np.arange(d)), pa.array(h), pa.array(lo), pa.array(t)],
                                  names=["d", "n", "i", "high", "low", "top"])

    long = "decimal(38,0)"
    rows = (fit.select("x").mapInArrow(totals, "d long, n long, i long, high long, low long, top long").groupBy("d", "i")
            .agg(F.sum("n").alias("n"), F.sum(F.col("high").cast(long)).alias("high"), F.sum(F.col("low").cast(long)).alias("low"), F.max("top").alias("top")).collect())
    by_d: dict[int, list] = {}
    for r in sorted(rows, key=lambda r: (r["d"], r["i"])):
        by_d.setdefault(r["d"], []).append(r)
    if by_d and max(by_d) > MAX_LENGTH:
        raise ValueError(f"vectors longer than {MAX_LENGTH} need a covariance beyond the driver's memory")
    fits = {d: Fit(rs[0]["n"], [int(r["high"]) * 2 ** 31 + int(r["low"]) for r in rs], max(r["top"] for r in rs)) for d, rs in by_d.items()}

    def products(f: Fit, x: np.ndarray) -> np.ndarray:
        c = f.centred(x)
        return c.T @ c

    if fits:
        matrices = _summed(fit, products, fits)
        fits = {d: Fit(f.n, f.total, f.top, matrices[d] / f.n, components) for d, f in fits.items()}

        def moments(f: Fit, x: np.ndarray) -> np.ndarray:
            w = f.whitened(x)
            return np.concatenate([w.sum(axis=0)[None, :], w.T @ w])

        for d, m in _summed(fit, moments, fits).items():
            f = fits[d]
            mean = m[0] / f.n                              # zero but for rounding: the vectors are centred already
            off = np.abs(m[1:] / f.n - np.outer(mean, mean) - np.eye(len(mean)))[np.ix_(f.spread, f.spread)]
            f.identity_error = float(off.max()) if off.size else None
    return fits


COLUMNS = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """``vectors`` has ``(vec_id, embedding)``; returns a row for each remaining vector and component with its whitened coordinate."""
    known = shipped(vectors.sparkSession, learn(fit_list(vectors), components))

    def project(batches):
        fits = known()
        for b in batches:
            for d, at, x in by_length(b.column(1)):
                f, ids = fits[d], b.column(0).take(pa.array(at))
                w, squared = f.whitened(x), pa.array(squares(deviations(x, f.n, f.total, f.top)), pa.int64())
                for k in range(w.shape[1]):
                    same = lambda v, t=pa.float64(): pa.array([v] * len(at), t)
                    yield pa.record_batch([ids, same(k + 1, pa.int32()), same(f.n, pa.int64()), squared, pa.array(w[:, k]) if f.spread[k] else same(None),
                                           same(f.explained[k]), same(f.identity_error)],
                                          names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), whole().alias("x")).where("x is not null and size(x) > 0")
    return rows.mapInArrow(project, COLUMNS)
