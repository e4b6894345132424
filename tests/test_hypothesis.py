"""Property tests: many random cases per Spark job (one group per case), checked against
independent numpy / pandas / exact-fraction implementations."""

import math
from fractions import Fraction

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from rubricon.operators import agree, profile

POINTS = [0.0, 0.5, 1.0, 1.5, 2.0, 3.0, 4.0]
SETTINGS = settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])

cases = st.lists(
    st.lists(st.tuples(st.sampled_from(POINTS), st.sampled_from(POINTS)), min_size=2, max_size=30),
    min_size=1, max_size=12)


def _ref_metrics(pairs):
    p = np.array([a for a, _ in pairs])
    l = np.array([b for _, b in pairs])
    points, place = np.unique(np.stack([p, l]), return_inverse=True)
    a, b = place.reshape(2, -1)
    k = len(points)
    o = np.zeros((k, k))
    for i, j in zip(b, a):
        o[i, j] += 1
    n = len(p)
    e = np.outer(o.sum(1), o.sum(0)) / n
    w = np.array([[(i - j) ** 2 for j in range(k)] for i in range(k)], dtype=float)
    u = 1 - np.eye(k)
    out = {
        "exact_accuracy": float(np.mean(p == l)), "mae": float(np.mean(np.abs(p - l))),
        "rmse": math.sqrt(float(np.mean((p - l) ** 2))), "acc_0.5": float(np.mean(np.abs(p - l) <= 0.5)),
        "qwk": None if (w * e).sum() == 0 else 1 - (w * o).sum() / (w * e).sum(),
        "kappa": None if (u * e).sum() == 0 else 1 - (u * o).sum() / (u * e).sum(),
    }
    out["pearson"] = None if p.std() == 0 or l.std() == 0 else float(np.corrcoef(p, l)[0, 1])
    rp, rl = pd.Series(p).rank().to_numpy(), pd.Series(l).rank().to_numpy()
    out["spearman"] = None if rp.std() == 0 or rl.std() == 0 else float(np.corrcoef(rp, rl)[0, 1])
    return out


@SETTINGS
@given(cases)
def test_metrics_match_reference_formulas(spark, data):
    rows = [(c, a, b) for c, pairs in enumerate(data) for a, b in pairs]
    df = spark.createDataFrame(rows, "case int, pred double, label double")
    got = {(r["case"], r["metric"]): r["value"] for r in agree.compute_metrics(df, group_cols=["case"]).collect()}
    for c, pairs in enumerate(data):
        for m, v in _ref_metrics(pairs).items():
            g = got[(c, m)]
            if v is None or (isinstance(v, float) and math.isnan(v)):
                assert g is None, (c, m, g, v)
            else:
                assert g == pytest.approx(v, abs=1e-9), (c, m, pairs)


values = st.lists(st.lists(st.integers(0, 300), min_size=1, max_size=40), min_size=1, max_size=10)


@SETTINGS
@given(values, st.integers(1, 12))
def test_histogram_matches_numpy(spark, data, bins):
    rows = [(c, float(v)) for c, vs in enumerate(data) for v in vs]
    df = spark.createDataFrame(rows, "case int, x double")
    got = {}
    for r in profile.histogram(df, "x", bins, ["case"]).collect():
        got.setdefault(r["case"], {})[r["bin"]] = r["n"]
    for c, vs in enumerate(data):
        counts, _ = np.histogram(np.array(vs, dtype=float), bins=bins)
        assert [got[c][i] for i in range(bins)] == counts.tolist(), (c, vs, bins)


@SETTINGS
@given(values)
def test_describe_matches_numpy(spark, data):
    rows = [(c, float(v)) for c, vs in enumerate(data) for v in vs]
    df = spark.createDataFrame(rows, "case int, x double")
    got = {r["case"]: r for r in profile.describe(df, "x", ["case"]).collect()}
    for c, vs in enumerate(data):
        x = np.array(vs, dtype=float)
        r = got[c]
        assert r["count"] == len(vs) and r["min"] == x.min() and r["max"] == x.max()
        assert r["mean"] == pytest.approx(x.mean(), abs=1e-9)
        assert (r["std"] is None) if len(vs) == 1 else r["std"] == pytest.approx(x.std(ddof=1), abs=1e-9)
        for p, name in [(0.25, "p25"), (0.5, "p50"), (0.9, "p90"), (0.99, "p99")]:
            assert r[name] == pytest.approx(float(np.percentile(x, p * 100)), abs=1e-9), (name, vs)


groups = st.lists(st.lists(st.integers(0, 10_000), min_size=1, max_size=60, unique=True), min_size=1, max_size=8)


@SETTINGS
@given(groups, st.sampled_from([0.1, 0.2, 0.25, 0.5, 0.9]), st.integers(0, 99))
def test_split_exact_matches_md5_order(spark, data, test_size, seed):
    import hashlib

    from rubricon.operators import prepare
    rows = [(g, str(k)) for g, keys in enumerate(data) for k in keys]
    df = spark.createDataFrame(rows, "g int, BMH string")
    got = {(r["g"], r["BMH"]): r["split"] for r in
           prepare.split_exact(df, ["BMH"], test_size, seed, group_cols=["g"]).collect()}
    assert len(got) == len(rows)
    for g, keys in enumerate(data):
        order = sorted((hashlib.md5(f"{seed}:{k}".encode()).hexdigest(), str(k)) for k in keys)
        n_test = math.ceil(len(keys) * test_size)
        want_test = {k for _, k in order[:n_test]}
        assert {k for (gg, k), sp in got.items() if gg == g and sp == "test"} == want_test


@SETTINGS
@given(st.lists(st.integers(0, 10_000), min_size=1, max_size=80, unique=True), st.integers(1, 7),
       st.integers(1, 3), st.integers(0, 99))
def test_shuffled_batches_match_md5_order(spark, keys, batch_size, epochs, seed):
    import hashlib

    from rubricon.operators import prepare
    df = spark.createDataFrame([(str(k),) for k in keys], "BMH string")
    got = {(r["epoch"], r["BMH"]): (r["batch_id"], r["batch_pos"]) for r in
           prepare.shuffled_batches(df, ["BMH"], batch_size, epochs, seed).collect()}
    for e in range(epochs):
        order = sorted((hashlib.md5(f"{seed}:{e}:{k}".encode()).hexdigest(), str(k)) for k in keys)
        for r, (_, k) in enumerate(order):
            assert got[(e, k)] == (r // batch_size, r % batch_size)


seqs = st.lists(st.tuples(st.integers(1, 6), st.integers(0, 2 ** 16)), min_size=1, max_size=6)


@SETTINGS
@given(seqs)
def test_pooling_matches_tensor_semantics(spark, spec):
    from rubricon.operators import pool
    dim, q = 3, np.array([0.5, -1.0, 0.25])
    rows, tensors = [], {}
    for s, (length, seed) in enumerate(spec):
        rnd = np.random.default_rng(seed)
        h = rnd.normal(size=(length, dim))
        m = (rnd.random(length) < 0.6).astype(int)
        tensors[s] = (h, m)
        rows += [(s, p, int(m[p]), h[p].tolist()) for p in range(length)]
    t = spark.createDataFrame(rows, "seq_id long, pos int, mask int, vec array<double>")
    got = {name: {r["seq_id"]: np.array(r["pooled"]) for r in df.collect()} for name, df in
           [("mean", pool.pool_mean(t)), ("last", pool.pool_last(t)), ("att", pool.pool_attention(t, q.tolist()))]}
    lowest = np.finfo(np.float64).min
    for s, (h, m) in tensors.items():
        mean = (h * m[:, None]).sum(0) / max(m.sum(), 1)
        last = h[int(m.sum()) - 1]
        sc = np.where(m == 1, h @ q, lowest)
        w = np.exp(sc - sc.max())
        att = (h * (w / w.sum())[:, None]).sum(0)
        assert np.allclose(got["mean"][s], mean, atol=1e-12)
        assert np.allclose(got["last"][s], last, atol=1e-12)
        assert np.allclose(got["att"][s], att, atol=1e-12)


probs = st.lists(st.lists(st.sampled_from([0.0, 0.5, 1.0, 0.25, 0.75, 0.1, 0.9, 0.3]), min_size=1, max_size=10),
                 min_size=1, max_size=40)


@SETTINGS
@given(probs)
def test_decode_matches_exact_brute_force(spark, rows):
    from rubricon.functions.ordinal import decode_scores
    df = spark.createDataFrame([(i, p) for i, p in enumerate(rows)], "i int, p array<double>")
    from pyspark.sql import functions as F
    pts = F.transform(F.sequence(F.lit(0), F.size("p")), lambda x: x.cast("double"))
    got = {r["i"]: r["s"] for r in df.select("i", decode_scores("p", pts).alias("s")).collect()}
    # Documented contract: distances within 1e-9 are ties and the lowest index wins, so
    # values like [0.1, 0.9] (equal distances up to binary representation) tie as they do
    # in the reference's float32 arithmetic.
    eps = Fraction(1, 10 ** 9)
    for i, p in enumerate(rows):
        best, bd = 0.0, None
        for k in range(len(p) + 1):
            d = sum(abs(Fraction(x) - (1 if k > j else 0)) for j, x in enumerate(p))
            if bd is None or d < bd - eps:
                best, bd = float(k), d
        assert got[i] == best, (p, got[i], best)
