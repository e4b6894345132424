"""Whitening against exact sums and a plain eigendecomposition."""

import math

import numpy as np
import pytest

from rubricon.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, n long, x int, d int, component string"


def vectors(rng, n, d, spread=0.2):
    turn = np.linalg.qr(rng.standard_normal((d, d)))[0]
    scale = spread * np.linspace(1.0, 0.2, d)
    return (rng.standard_normal((n, d)) * scale) @ turn + 0.1


def brute(rows):
    kept = [(i, [math.floor(256 * float(c)) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, total = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[n * c - s for c, s in zip(x, total)] for x in fit], float) / n
    v = centred.T @ centred / n
    value, vector = np.linalg.eigh(v)
    value, vector = value[::-1], vector[:, ::-1]
    out = {}
    for i, x in kept:
        dev = [n * c - s for c, s in zip(x, total)]
        w = np.array(dev, float) / n @ vector[:, :4] / np.sqrt(value[:4])
        out.setdefault((i, tuple(x)), []).append((n, sum(e * e for e in dev), w, value[:4] / np.trace(v)))
    return out


def check(spark, rows, parts=3):
    df = spark.createDataFrame([(i, v, 1, 2, 3, "c") for i, v in rows], SCHEMA).repartition(parts)
    got = whitening.whiten(df).collect()
    expected = brute([(r["vec_id"], r["embedding"]) for r in df.collect()])
    by_row = {}
    for r in got:
        by_row.setdefault((r["vec_id"], r["deviation"]), []).append(r)
    sign, seen = {}, 0
    for (i, _), copies in expected.items():
        n, dev, w, explained = copies[0]
        mine = [r for r in by_row[(i, dev)]]
        assert len(mine) == len(copies) * len(w) and {r["n"] for r in mine} == {n}
        for r in mine:
            k = r["component"] - 1
            s = sign.setdefault(k, math.copysign(1, r["whitened"] * w[k])) if abs(w[k]) > 1e-3 else sign.get(k, 1)
            assert abs(s * r["whitened"] - w[k]) < 1e-8
            assert abs(r["explained"] - explained[k]) < 1e-10
            assert r["identity_error"] < 1e-9
            seen += 1
    assert seen == len(got)


def test_against_numpy(spark):
    rng = np.random.default_rng(3)
    data = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(vectors(rng, 400, 12))]
    data += [(None, data[3][1])] + [(900 + i, data[5][1]) for i in range(200)] + [data[7]] * 3
    data += [(2000, None), (2001, [None] + [0.1] * 11), (2002, [math.nan] * 12), (2003, [math.inf] + [0.0] * 11), (2004, [-0.0] * 12)]
    check(spark, data)


def test_few_entries(spark):
    rng = np.random.default_rng(4)
    check(spark, [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(vectors(rng, 60, 2))])


def test_no_spread_and_lengths(spark):
    df = spark.createDataFrame([(1, [0.5, 0.25], 1, 2, 3, "c"), (2, [0.5, 0.25], 1, 2, 3, "c"), (3, [], 1, 2, 3, "c"), (4, [0.0], 1, 2, 3, "c"), (5, [1.0], 1, 2, 3, "c")], SCHEMA)
    got = {(r["vec_id"], r["component"]): r for r in whitening.whiten(df).collect()}
    assert set(got) == {(1, 1), (1, 2), (2, 1), (2, 2), (4, 1), (5, 1)}
    assert got[1, 1]["whitened"] is None and got[1, 1]["explained"] is None and got[1, 1]["n"] == 1 and got[1, 1]["deviation"] == 0
    assert abs(got[4, 1]["whitened"]) == pytest.approx(1) and got[4, 1]["deviation"] == 256 ** 2 and got[4, 1]["explained"] == pytest.approx(1)


def test_large_entries(spark):
    big = 2.0 ** 53
    df = spark.createDataFrame([(1, [big, 0.0], 1, 2, 3, "c"), (2, [-big, 1.0], 1, 2, 3, "c"), (3, [1e30, 0.0], 1, 2, 3, "c")], SCHEMA)
    got = whitening.whiten(df).collect()
    assert {r["vec_id"] for r in got} == {1, 2} and all(r["deviation"] is None and r["n"] == 2 for r in got)


def test_empty(spark):
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).collect() == []


def test_refinement_separates_clusters():
    rng = np.random.default_rng(5)
    q = np.linalg.qr(rng.standard_normal((40, 40)))[0]
    value = np.concatenate([[5, 5 - 1e-9, 5 - 2e-9, 5 - 1e-8], np.linspace(3, 1, 34), [1e-7, 1e-7]])
    long = lambda m: m.astype(np.longdouble)
    ortho = long(q)
    for _ in range(4):                                  # orthogonal in extended precision
        ortho = ortho @ (1.5 * np.eye(40) - 0.5 * ortho.T @ ortho)
    a = ((ortho * value) @ ortho.T).astype(float)
    a = (a + a.T) / 2
    got, x = whitening.refined(a)
    assert np.abs(got - value).max() < 1e-14
    assert np.abs(x.T @ x - np.eye(40)).max() < 1e-15
    assert np.abs(long(a) @ long(x) - long(x) * got).max() < 1e-14
    plain = np.linalg.eigh(a.astype(np.float32))[1]
    assert np.abs(plain.T @ a @ plain - np.diag(np.diag(plain.T @ a @ plain))).max() > 1e-8


def test_refinement_of_equal_and_zero_eigenvalues():
    got, x = whitening.refined(np.diag([2.0, 2.0, 0.0, 2.0]))
    assert got.tolist() == [2.0, 2.0, 2.0, 0.0] and np.abs(x.T @ x - np.eye(4)).max() < 1e-15
    got, x = whitening.refined(np.zeros((3, 3)))
    assert got.tolist() == [0, 0, 0] and (x == np.eye(3)).all()
