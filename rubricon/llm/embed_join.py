"""Embedding near-duplicates by cells around sampled centres in two halves of the dimensions.

The cosine of two vectors is a weighted mean of the cosines of their halves, with weights that add up to one at most.  So vectors of
cosine at least ``c`` have a half of cosine at least ``c``.  Both halves are searched for such pairs; a pair counts in the first
half that has it, and only if the whole vectors have the cosine.

In each half a share of the vectors are centres, and every vector lives in the cell of the nearest (any centre would be right, a
near one saves work).  Directions of cosine at least ``c`` are within the angle ``t = arccos(c)`` of each
other.  So a vector is compared with members of a cell, all within the angle ``a`` of its centre, only if it is within ``a + t`` of
this centre.  Members are sorted by their angle and taken in rings, each with its own ``a``.  They are first compared by an orthogonal
projection to fewer dimensions, which never adds to a distance, then by their whole halves, then by the whole vectors, in
double precision where single precision can't tell.

For each half, vectors move once: to blobs of whole cells, where equal vectors meet and are joined once, as one
vector with a weight.  All pairs of blobs are read again from the staged files, not sent to each other, so the disk used is
proportional to the table: two copies staged and one shuffled at a time.  Tasks return a count for each vector and a spanning
forest of their links, never pairs.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components link with nothing and are their own
component; vectors of different lengths do not link; repeated rows are vectors of their own; an empty table
gives an empty result; a null id keeps its row (component: smallest id reachable, null if there is none).
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rubricon.llm.common import components, shipped, staged, tidied
from rubricon.session import checkpoint_dir

COSINE = 0.95
TILE = 65_536                         # vectors of a blob
BLOB_BYTES = 16 * 2 ** 20             # of its vectors
HALVES = 2
CENTRE_BYTES = 16 * 2 ** 20           # of all vectors that centres are taken from, in single precision
SAME_HALF = 1e-9                      # a half counts as found from this below the threshold on
AT_ONCE = 4_000_000                   # products held at a time
IN_CACHE = 262144                    # distances held at a time
RINGS, SMALLEST, LARGEST = 4, 64, 512  # rings of a cell, and members of one
PENDING = 200_000                     # links kept before they are merged into labels
MOST_TASKS = 512                      # beyond, a task takes several pairs of blobs


def margin(dim: int) -> float:
    """More than the error of a product of two unit vectors in single precision."""
    return (dim + 16) * 2.0 ** -22


def scaled(raw: np.ndarray) -> np.ndarray:
    """Rows times a power of two each, which changes no cosine and keeps squares in range."""
    x = np.ascontiguousarray(raw, np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def units(raw: np.ndarray) -> np.ndarray:
    out = np.empty(raw.shape, np.float32)
    for s in range(0, len(raw), 8192):
        x = scaled(raw[s:s + 8192])
        out[s:s + 8192] = x / np.linalg.norm(x, axis=1, keepdims=True)
    return out


def halves(dim: int, seed: int = 6) -> list[np.ndarray]:
    """The dimensions of each half, at random."""
    return [np.sort(p) for p in np.array_split(np.random.default_rng([seed, dim]).permutation(dim), HALVES) if len(p)]


def projection(dim: int, seed: int = 6) -> np.ndarray:
    """An orthonormal base of random directions, 16 or a quarter of all."""
    to = min(dim, max(16, -(-dim // 4)))
    return np.linalg.qr(np.random.default_rng([seed, dim]).standard_normal((dim, to)))[0].astype(np.float32)


def rounded(u: np.ndarray) -> np.ndarray:
    """Unit vectors in whole numbers whose products, and all parts of them, are exact in single precision."""
    return np.rint(u * np.float32(2048))


class Centres:
    """Unit vectors of one length, and the search for the nearest.

    The search takes rounded vectors, so equal vectors find the same centre whatever the vectors beside them.
    """

    def __init__(self, centres: np.ndarray):
        self.centres, self.whole = centres, rounded(centres)

    def nearest(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The centre nearest to each vector and the cosine to it."""
        cells, near = np.empty(len(u), np.int64), np.empty(len(u), np.float32)
        step = max(64, AT_ONCE // len(self.centres))
        for s in range(0, len(u), step):
            part = u[s:s + step]
            cells[s:s + step] = best = np.argmax(rounded(part) @ self.whole.T, axis=1)
            near[s:s + step] = np.einsum("ij,ij->i", part, self.centres[best])
        return cells, near


def assigned(known: dict[int, Centres], dim: int, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cell and cosine to its centre; where no centre has this length there is one cell, -1, which holds every direction."""
    if dim in known:
        return known[dim].nearest(u)
    return np.full(len(u), -1), np.full(len(u), -1, np.float32)


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Label of each of ``n`` nodes under links ``a``-``b``: the smallest node connected."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def few(mask: np.ndarray) -> np.ndarray:
    """``np.flatnonzero`` of a mask in which little is true: eight places are looked at together."""
    mask = mask.ravel()
    n = len(mask) // 8 * 8
    words = np.flatnonzero(mask[:n].view(np.uint64))
    if not len(words):
        return np.flatnonzero(mask[n:]) + n
    word, place = np.nonzero(mask[:n].reshape(-1, 8)[words])
    return np.concatenate([words[word] * 8 + place, np.flatnonzero(mask[n:]) + n])


class Part:
    """The vectors of one length in a blob, by cell of one half and falling cosine to its centre."""

    def __init__(self, half: int, nodes: np.ndarray, weights: np.ndarray, cells: np.ndarray, cosines: np.ndarray, raw: np.ndarray):
        self.nodes, self.weights, self.cells, self.cosines, self.raw, self.half = nodes, weights, cells, cosines, raw, half
        self.dims = halves(raw.shape[1])
        self.halves, self.norms = [np.empty((len(raw), len(d)), np.float32) for d in self.dims], np.empty((len(raw), len(self.dims)), np.float32)
        for s in range(0, len(raw), 8192):
            x = scaled(raw[s:s + 8192])
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            for k, d in enumerate(self.dims):
                part = np.take(x, d, axis=1)
                norm = np.linalg.norm(part, axis=1)
                self.norms[s:s + 8192, k] = norm
                self.halves[k][s:s + 8192] = part / np.where(norm > 0, norm, 1)[:, None]
        p = self.halves[half] @ projection(len(self.dims[half]))
        squares, ones = (p * p).sum(axis=1), np.ones(len(p), np.float32)
        # squared distance as one product: (-2p, |p|^2, 1) . (p, 1, |p|^2)
        self.left, self.right = np.c_[-2 * p, squares, ones], np.c_[p, ones, squares]


class Links:
    """Weighted links of each vector of two parts and what they connect."""

    def __init__(self, a: Part, b: Part):
        self.a, self.b, self.shift = a, b, 0 if a is b else len(a.nodes)
        self.count_a = np.zeros(len(a.nodes))
        self.count_b = self.count_a if a is b else np.zeros(len(b.nodes))
        self.label = np.arange(self.shift + len(b.nodes))
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, x: np.ndarray, lo: int, hi: int, column: np.ndarray, at: np.ndarray) -> None:
        """Rows ``x`` of ``a``, all in ``lo..hi``, link with rows ``at[column]`` of ``b``."""
        y = at[column]
        self.count_a[lo:hi] += np.bincount(x - lo, self.b.weights[y], hi - lo)
        self.count_b[at] += np.bincount(column, self.a.weights[x], len(at))
        la, lb = self.label[x], self.label[y + self.shift]
        apart = la != lb
        if apart.any():
            self.waiting.append((la[apart], lb[apart]))
            if sum(len(w[0]) for w in self.waiting) > PENDING:
                self.merge()

    def merge(self) -> None:
        if self.waiting:
            low, high = (np.concatenate(side) for side in zip(*self.waiting, strict=True))
            self.label = forest(low, high, len(self.label))[self.label]
            self.waiting = []

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(a, b, n)``: counts of nodes as ``(node, node, n)``, what a node is connected with as ``(node, other, 0)``."""
        self.merge()
        nodes = self.a.nodes if self.a is self.b else np.concatenate([self.a.nodes, self.b.nodes])
        count = self.count_a if self.a is self.b else np.concatenate([self.count_a, self.count_b])
        has, moved = np.flatnonzero(count), np.flatnonzero(self.label != np.arange(len(nodes)))
        return (np.concatenate([nodes[has], nodes[moved]]), np.concatenate([nodes[has], nodes[self.label[moved]]]),
                np.concatenate([count[has].astype(np.int64), np.zeros(len(moved), np.int64)]))


def exact(a: Part, b: Part, x: np.ndarray, y: np.ndarray, dims: np.ndarray | None = None) -> np.ndarray:
    """Cosines, of all dimensions or of ``dims``, in double precision."""
    out = np.empty(len(x))
    for s in range(0, len(x), 20_000):
        p, q = np.take(a.raw, x[s:s + 20_000], axis=0), np.take(b.raw, y[s:s + 20_000], axis=0)
        p, q = (scaled(r if dims is None else np.take(r, dims, axis=1)) for r in (p, q))
        size = np.linalg.norm(p, axis=1) * np.linalg.norm(q, axis=1)
        out[s:s + 20_000] = np.einsum("ij,ij->i", p, q) / np.where(size > 0, size, 1)
    return out


def at_least(a: Part, b: Part, x: np.ndarray, y: np.ndarray, cosines: np.ndarray, least: float, dims: np.ndarray | None = None) -> np.ndarray:
    """Whether cosines, known in single precision, are at least ``least``."""
    slack = margin(a.raw.shape[1])
    out = cosines >= least + slack
    unsure = np.flatnonzero(~out & (cosines >= least - slack))
    if len(unsure):
        out[unsure] = exact(a, b, x[unsure], y[unsure], dims) >= least
    return out


def joined(a: Part, b: Part, centres: Centres | None, cosine: float) -> Links:
    """All links between ``a`` and ``b`` that their half is the first to find, each pair once also if they are the same."""
    same, links, half, dim = a is b, Links(a, b), a.half, a.raw.shape[1]
    slack, reach, turn = margin(dim), 2 - 2 * cosine, np.arccos(np.clip(cosine, -1, 1))
    mine, theirs = a.halves[half], b.halves[half]
    starts = np.flatnonzero(np.r_[True, np.diff(a.cells) != 0])
    ends = np.r_[starts[1:], len(a.cells)]

    def least(own):
        """What a vector's cosine to the centre is at least if it links with a member whose cosine is ``own`` or more."""
        return np.cos(np.minimum(np.pi, np.arccos(np.clip(own - slack, -1, 1)) + turn)) - slack

    def product(k: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        step = max(1, AT_ONCE // (4 * dim))
        return np.concatenate([np.einsum("ij,ij->i", np.take(a.halves[k], x[i:i + step], axis=0), np.take(b.halves[k], y[i:i + step], axis=0))
                               for i in range(0, len(x), step)])

    def compare(lo: int, hi: int, at: np.ndarray, right: np.ndarray) -> None:
        wide = max(64, IN_CACHE // (hi - lo))
        for s in range(0, len(at), wide):
            place = at[s:s + wide]
            close = few(a.left[lo:hi] @ right[s:s + wide].T <= np.float32(reach + 4 * slack))
            if not len(close):
                continue
            x, column = close // len(place) + lo, close % len(place)
            if same:
                once = place[column] > x
                x, column, close = x[once], column[once], close[once]
            if len(close) * 20 > (hi - lo) * len(place):
                cos = [(a.halves[k][lo:hi] @ np.take(b.halves[k], place, axis=0).T).ravel()[close] for k in range(len(a.dims))]
                keep = np.flatnonzero(cos[half] >= cosine - slack)
                x, column, cos = x[keep], column[keep], [c[keep] for c in cos]
            elif len(close):
                own = product(half, x, place[column])
                keep = np.flatnonzero(own >= cosine - slack)
                x, column = x[keep], column[keep]
                cos = [own[keep] if k == half else product(k, x, place[column]) if len(x) else own[keep] for k in range(len(a.dims))]
            if not len(x):
                continue
            y = place[column]
            whole = sum(c * a.norms[x, k] * b.norms[y, k] for k, c in enumerate(cos))
            keep = at_least(a, b, x, y, whole, cosine)
            for k in range(half + 1):                   # this half has the pair, no earlier one has it
                some = np.flatnonzero(keep)
                keep[some] = at_least(a, b, x[some], y[some], cos[k][some], cosine - SAME_HALF, a.dims[k]) == (k == half)
            if keep.any():
                links.add(x[keep], lo, hi, column[keep], place)

    group = max(1, AT_ONCE // max(1, len(b.nodes)))
    for g in range(0, len(starts), group):
        cells = a.cells[starts[g:g + group]]
        middles = np.zeros((len(cells), mine.shape[1]), np.float32) if centres is None else centres.centres[cells]
        products = middles @ theirs.T
        for near, start, end in zip(products, starts[g:g + group], ends[g:g + group], strict=True):
            first = start if same else 0
            ring = min(max((end - start) // RINGS, SMALLEST), LARGEST)
            begins = np.arange(start, end, ring)
            bounds = least(a.cosines[np.minimum(begins + ring, end) - 1]).astype(np.float32)
            at = np.flatnonzero(near[first:] >= bounds[-1]) + first
            if not len(at):
                continue
            if len(begins) > 1:                         # by the innermost ring that each has to be compared with
                inner = np.searchsorted(-bounds, -near[at]).astype(np.uint16)
                order = np.argsort(inner, kind="stable")
                at, upto = at[order], np.cumsum(np.bincount(inner, minlength=len(begins)))
            else:
                upto = [len(at)]
            right = np.take(b.right, at, axis=0)
            for lo, n in zip(begins, upto, strict=True):
                if n:
                    compare(lo, min(end, lo + ring), at[:n], right[:n])
    return links


def _parts(row: dict, half: int, kind: str) -> dict[int, Part]:
    ints = lambda name: np.frombuffer(row[name], "<i4")
    nodes, weights = np.frombuffer(row["nodes"], "<i8"), np.frombuffer(row["weights"], "<i8")
    cosines, raw, out, lo, begin = np.frombuffer(row["cosines"], "<f4"), np.frombuffer(row["raw"], kind), {}, 0, 0
    weights = weights if len(weights) else np.ones(len(nodes), np.int64)
    dims, cells, counts = ints("dims"), ints("cells"), ints("counts")
    for dim in np.unique(dims):                         # cells are sorted by length
        of = dims == dim
        hi = lo + int(counts[of].sum())
        end = begin + (hi - lo) * int(dim)
        out[int(dim)] = Part(half, nodes[lo:hi], weights[lo:hi], np.repeat(cells[of], counts[of]), cosines[lo:hi], raw[begin:end].reshape(-1, int(dim)))
        lo, begin = hi, end
    return out


BLOB = pa.schema([("blob", pa.int64()), *((n, pa.binary()) for n in ("dims", "cells", "counts", "nodes", "weights", "cosines", "raw"))])
BLOB_COLUMNS = "blob long, dims binary, cells binary, counts binary, nodes binary, weights binary, cosines binary, raw binary"


def _packed(got: pa.Table, blob: int, most_rows: int, size: int):
    """Blobs of the rows of ``got``, equal ones joined."""
    dim, cell, node, weight, near = (got[c].to_numpy() for c in ("dim", "cell", "node", "weight", "near"))
    raw = got["raw"].combine_chunks()
    order = np.lexsort((node, cell, dim))
    new = np.r_[True, (np.diff(node[order]) != 0) | (np.diff(cell[order]) != 0) | (np.diff(dim[order]) != 0)]
    weight = np.add.reduceat(weight[order], np.flatnonzero(new))
    order = order[new]                                  # one of each vector, with the weight of all
    by = np.lexsort((-near[order], cell[order], dim[order]))
    order, weight = order[by], weight[by]
    before = np.cumsum(dim[order] * size) - dim[order] * size
    ints = lambda x: x.astype("<i4").tobytes()
    for at in np.split(np.arange(len(order)), np.flatnonzero(np.diff(before // (2 * BLOB_BYTES))) + 1):
        for s in range(0, len(at), most_rows):
            use, weights = order[at[s:s + most_rows]], weight[at[s:s + most_rows]]
            run = np.flatnonzero(np.r_[True, (np.diff(cell[use]) != 0) | (np.diff(dim[use]) != 0)])
            values = raw.take(pa.array(use))
            begin, end = np.frombuffer(values.buffers()[1], "<i4")[[values.offset, values.offset + len(values)]]
            yield pa.RecordBatch.from_pylist([{
                "blob": blob, "dims": ints(dim[use][run]), "cells": ints(cell[use][run]), "counts": ints(np.diff(np.r_[run, len(use)])),
                "nodes": node[use].astype("<i8").tobytes(), "weights": weights.astype("<i8").tobytes() if weights.max() > 1 else b"",
                "cosines": near[use].astype("<f4").tobytes(), "raw": values.buffers()[2].slice(begin, end - begin).to_pybytes()}], BLOB)
            blob += 1


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, tile: int = TILE) -> DataFrame:
    """``vectors`` has ``(vec_id, embedding)``; returns ``(vec_id, n_links, component_id, kept)`` of every row."""
    if cosine <= 0:
        raise ValueError("a pair of a cosine that is not positive may have it in neither half")
    spark = vectors.sparkSession
    single = vectors.schema["embedding"].dataType.elementType.simpleString() == "float"
    kind, item = ("<f4", "float") if single else ("<f8", "double")
    size = np.dtype(kind).itemsize
    hashed = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.xxhash64("embedding").alias("node"),
                            F.col("embedding").cast(f"array<{item}>").alias("v"))

    def narrow(batches):
        for b in batches:
            dims = np.zeros(b.num_rows, np.int64)
            for dim, at, _ in _by_length(b.column(2), kind):
                dims[at] = dim
            yield pa.record_batch([b.column(0), b.column(1), pa.array(dims, mask=dims == 0)], names=["vec_id", "node", "dim"])

    rows = staged(hashed.mapInArrow(tidied(narrow), "vec_id long, node long, dim long"))
    rows = rows.select("vec_id", "dim", F.when(F.col("dim").isNotNull(), F.col("node")).alias("node"))
    total = rows.agg(F.count("dim").alias("n"), F.sum("dim").alias("entries")).first()
    n, entries = total["n"], total["entries"] or 1
    wanted = max(1, int(min(0.7 * n ** (2 / 3), CENTRE_BYTES * max(n, 1) / (4 * entries))))
    share = int(min(1.0, wanted / max(n, 1)) * 2 ** 31)
    sampled: dict[int, list] = {}
    for r in (hashed.where(F.pmod(F.xxhash64("node", F.lit(6)), F.lit(2 ** 31)) < share).groupBy("node").agg(F.first("v").alias("v")).collect()):
        raw = np.array([np.nan] if r["v"] is None else [np.nan if x is None else x for x in r["v"]], np.float64)
        if np.isfinite(raw).all() and raw.any():
            sampled.setdefault(len(raw), []).append((r["node"], raw))
    blobs = int(max(1, min(8, n // 1000), -(-n // tile), -(-entries * size // BLOB_BYTES)))
    # a session of its own, with a task for each pair of blobs; cartesian products read their sides, no side is sent
    apart = spark.newSession()
    for key, value in {"spark.sql.files.maxPartitionBytes": "1g", "spark.sql.files.openCostInBytes": "1g", "spark.sql.autoBroadcastJoinThreshold": "-1",
                       "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.execution.arrow.maxRecordsPerBatch": "1"}.items():
        apart.conf.set(key, value)

    def searched(half: int) -> DataFrame:
        """``(a, b, n)``: what half ``half`` is the first to find, ``(node, node, links)`` and ``(node, node connected, 0)``."""
        known = {}
        for dim, vs in sampled.items():
            of = halves(dim)[half:half + 1]
            part = np.array([v for _, v in sorted(vs, key=lambda x: x[0])])[:, of[0]] if of else np.empty((0, 0))
            part = part[part.any(axis=1)]
            if len(part):
                known[dim] = Centres(units(part))
        centres = shipped(spark, known)

        def place(batches):
            of = centres()
            for b in batches:
                for dim, at, raw in _by_length(b.column(1), kind):
                    if half >= len(halves(dim)):
                        continue
                    node, first, weight = np.unique(b.column(0).to_numpy()[at], return_index=True, return_counts=True)
                    raw = raw[first]
                    part = np.take(raw, halves(dim)[half], axis=1)
                    some = part.any(axis=1)             # a half that is zero has no direction
                    node, weight, raw, part = node[some], weight[some], np.ascontiguousarray(raw[some]), part[some]
                    if not len(node):
                        continue
                    cell, near = assigned(of, dim, units(part))
                    to = cell * blobs // len(of[dim].centres) if dim in of else node % blobs
                    offsets = pa.array(np.arange(len(node) + 1, dtype=np.int32) * np.int32(dim * size))
                    yield pa.record_batch([pa.array(to.astype(np.int32)), pa.array(np.full(len(node), dim)), pa.array(cell), pa.array(node), pa.array(weight), pa.array(near),
                                           pa.Array.from_buffers(pa.binary(), len(node), [None, offsets.buffers()[1], pa.py_buffer(raw)])],
                                          names=["to", "dim", "cell", "node", "weight", "near", "raw"])

        def pack(batches):
            from pyspark import TaskContext

            if batches := [b for b in batches if b.num_rows]:
                yield from _packed(pa.Table.from_batches(batches), TaskContext.get().partitionId() << 24, 2 * tile, size)

        def meet(batches):
            of, last = centres(), (None, None)
            for b in batches:
                for i in range(b.num_rows):
                    sides = {s: {name[2:]: b.column(name)[i].as_buffer() for name in b.schema.names if name[0] == s and name[2:] != "blob"} for s in "ab"}
                    key, other = b.column("a_blob")[i].as_py(), b.column("b_blob")[i].as_py()
                    if last[0] != key:
                        last = (key, _parts(sides["a"], half, kind))
                    left = last[1]
                    right = left if other == key else _parts(sides["b"], half, kind)
                    for dim in sorted(left.keys() & right.keys()):
                        a, c, count = joined(left[dim], right[dim], of.get(dim), cosine).result()
                        yield pa.record_batch([pa.array(a), pa.array(c), pa.array(count)], names=["a", "b", "n"])

        packed = f"{checkpoint_dir(spark)}/staged-{uuid.uuid4().hex}"
        (hashed.where("v is not null").select("node", "v")
         .mapInArrow(tidied(place), "to int, dim long, cell long, node long, weight long, near float, raw binary")
         .repartitionById(blobs, "to").mapInArrow(tidied(pack), BLOB_COLUMNS)
         .write.option("compression", "none").option("parquet.enable.dictionary", "false").parquet(packed))
        a, b = (apart.read.schema(BLOB_COLUMNS).parquet(packed).select(*[F.col(c).alias(f"{side}_{c}") for c in BLOB.names]) for side in "ab")
        pairs = a.crossJoin(b).where("a_blob <= b_blob").mapInArrow(tidied(meet), "a long, b long, n long")
        pairs.coalesce(max(MOST_TASKS, blobs * blobs // 8)).write.parquet(f"{packed}-links")
        return spark.read.schema(pairs.schema).parquet(f"{packed}-links")

    found = searched(0)
    for half in range(1, HALVES):
        found = found.unionAll(searched(half))
    links = found.where("n > 0").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    label = components(found.where("n = 0").select("a", "b"))
    distinct = rows.where("node is not null").groupBy("node").agg(F.count("*").alias("weight"), F.min("vec_id").alias("first_id"))
    known = (distinct.join(links, "node", "left").join(label, "node", "left")
             .select("node", "weight", "first_id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("label", "node").alias("label")))
    known = staged(known)
    smallest = known.groupBy("label").agg(F.min("first_id").alias("component_id"))
    known = known.join(smallest, "label").select("node", (F.col("n") + F.col("weight") - 1).alias("n_links"), "component_id")
    out = rows.select("vec_id", "node").join(known, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def _by_length(column, kind: str):
    """Rows of an Arrow list column whose vectors are sound, by length: ``(length, row numbers, matrix)``."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = column.offsets.to_numpy()
    length = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(offsets), 0)
    values = column.values.to_numpy(zero_copy_only=False)
    for dim in np.unique(length[length > 0]):
        at = np.flatnonzero(length == dim)
        matrix = values[offsets[at][:, None] + np.arange(dim)].astype(kind)
        sound = np.isfinite(matrix).all(axis=1) & matrix.any(axis=1)
        if sound.any():
            yield int(dim), at[sound], matrix[sound]
