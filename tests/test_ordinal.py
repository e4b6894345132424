"""Ordinal head: decode, loss, LayerNorm/GELU, linear and deep heads, fitting, weight tables."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rubricon.functions.ordinal import decode_scores, sigmoid
from rubricon.operators import ordinal
from rubricon.sources.sinks import OrdinalHead, load_head, save_head

POINTS = [0.0, 0.5, 1.0, 1.5]
DECODE = [
    ([.9, .8, .2], 1.0), ([.1, .1, .1], 0.0), ([.9, .9, .9], 1.5), ([.5, .5, .5], 0.0),
    ([.2, .9, .9], 1.5), ([.9, .2, .9], 1.5), ([float("nan"), .9, .9], 0.0),
]


def test_decode_golden(spark):
    df = spark.createDataFrame([(i, p) for i, (p, _) in enumerate(DECODE)], "i int, p array<double>")
    got = {r["i"]: r["s"] for r in df.select("i", decode_scores("p", POINTS).alias("s")).collect()}
    for i, (_, want) in enumerate(DECODE):
        assert got[i] == want, DECODE[i]


def test_decode_null_array_is_null(spark):
    df = spark.createDataFrame([(None,)], "p array<double>")
    assert df.select(decode_scores("p", POINTS).alias("s")).first()["s"] is None


def _brute(p, points):
    from fractions import Fraction
    best, bd = points[0], None
    for k in range(len(points)):
        d = sum(abs(Fraction(x) - (1 if k > j else 0)) for j, x in enumerate(p))
        if bd is None or d < bd:
            best, bd = points[k], d
    return best


def test_decode_equals_brute_force(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(400):
        k = rnd.randint(1, 12)
        rows.append((i, [rnd.choice([rnd.random(), 0.5, 0.0, 1.0]) for _ in range(k)]))
    df = spark.createDataFrame(rows, "i int, p array<double>")
    pts = F.transform(F.sequence(F.lit(0), F.size("p")), lambda x: x.cast("double"))
    got = {r["i"]: r["s"] for r in df.select("i", decode_scores("p", pts).alias("s")).collect()}
    for i, p in rows:
        assert got[i] == _brute(p, [float(v) for v in range(len(p) + 1)])


def test_loss_golden(spark):
    df = spark.createDataFrame([([2.0, -1.0, 0.0], 1), ([0.5, 0.5, -3.0], 3)], "logits array<double>, label_idx int")
    r = ordinal.ordinal_loss(df).first()
    assert round(r["loss"], 6) == 0.855013
    assert r["n_rows"] == 2 and r["n_terms"] == 6


def test_sigmoid_saturates_without_error(spark):
    r = spark.range(1).select(sigmoid(F.lit(800.0)).alias("a"), sigmoid(F.lit(-800.0)).alias("b")).first()
    assert r["a"] == 1.0 and r["b"] == 0.0


def test_layer_norm_and_gelu_golden():
    ln = ordinal.layer_norm(np.array([[1.0, 2.0, 4.0]]), np.ones(3), np.zeros(3))
    assert np.round(ln, 6).tolist() == [[-1.069042, -0.26726, 1.336302]]
    g = ordinal.gelu(np.array([-1.0, 0.0, 1.0, 2.0]))
    assert np.round(g, 6).tolist() == [-0.158655, 0.0, 0.841345, 1.9545]


def _vecs(spark, n=50, d=6, seed=1):
    rnd = np.random.default_rng(seed)
    x = rnd.normal(size=(n, d))
    df = spark.createDataFrame([(i, x[i].tolist()) for i in range(n)], "id int, vec array<double>")
    return df, x


def test_linear_head_expr_equals_numpy(spark):
    df, x = _vecs(spark)
    head = OrdinalHead(coef=np.arange(18.0).reshape(3, 6) / 10, intercept=np.array([0.1, -0.2, 0.3]),
                       score_points=[0, 1, 2, 3])
    a = {r["id"]: r["logits"] for r in ordinal.linear_head(df, head, vec="vec", method="expr").collect()}
    b = {r["id"]: r["logits"] for r in ordinal.linear_head(df, head, vec="vec", method="numpy").collect()}
    want = x @ head.coef.T + head.intercept
    for i in range(len(x)):
        assert np.allclose(a[i], want[i]) and np.allclose(b[i], want[i])


def test_linear_head_concat_features(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0], [3.0])], "id int, vec array<double>, f array<double>")
    head = OrdinalHead(coef=np.array([[1.0, 1.0, 1.0]]), intercept=np.array([0.5]), score_points=[0, 1])
    assert ordinal.linear_head(df, head, vec="vec", features="f").first()["logits"] == [6.5]


def test_deep_head_matches_manual_forward(spark):
    df, x = _vecs(spark, n=20, d=4)
    rnd = np.random.default_rng(5)
    w1, b1, p1 = rnd.normal(size=(3, 4)), rnd.normal(size=3), rnd.normal(size=(3, 4))
    w2, b2 = rnd.normal(size=(3, 3)), rnd.normal(size=3)
    g1, be1 = rnd.normal(size=4), rnd.normal(size=4)
    head = OrdinalHead(coef=rnd.normal(size=(2, 3)), intercept=rnd.normal(size=2), score_points=[0, 1, 2],
                       blocks=[(g1, be1, w1, b1, p1, np.zeros(3)), (np.ones(3), np.zeros(3), w2, b2, None, None)])
    got = {r["id"]: r["logits"] for r in ordinal.deep_head(df, head, vec="vec").collect()}

    def ln(v, g, b):
        mu = v.mean()
        var = ((v - mu) ** 2).mean()
        return (v - mu) / math.sqrt(var + 1e-5) * g + b

    def gelu(v):
        return np.array([0.5 * t * (1 + math.erf(t / math.sqrt(2))) for t in v])

    for i in range(len(x)):
        h = gelu(w1 @ ln(x[i], g1, be1) + b1) + p1 @ x[i]
        h = gelu(w2 @ ln(h, np.ones(3), np.zeros(3)) + b2) + h
        assert np.allclose(got[i], head.coef @ h + head.intercept)


def test_fit_thresholds_lowers_loss_and_repeats(spark):
    rnd = np.random.default_rng(0)
    n, d = 300, 5
    x = rnd.normal(size=(n, d))
    score = x @ np.array([1.0, -0.5, 0.3, 0.0, 0.8])
    idx = np.digitize(score, [-1.0, 0.0, 1.0])
    df = spark.createDataFrame([(x[i].tolist(), int(idx[i])) for i in range(n)], "vec array<double>, label_idx int")
    h1 = ordinal.fit_thresholds(df, vec="vec", n_classes=4, reg_param=1e-3, max_iter=50)
    h2 = ordinal.fit_thresholds(df, vec="vec", n_classes=4, reg_param=1e-3, max_iter=50)
    assert np.allclose(h1.coef, h2.coef) and np.allclose(h1.intercept, h2.intercept)
    fitted = ordinal.ordinal_loss(ordinal.linear_head(df, h1, vec="vec")).first()["loss"]
    zero = OrdinalHead(coef=np.zeros((3, d)), intercept=np.zeros(3), score_points=[0, 1, 2, 3])
    base = ordinal.ordinal_loss(ordinal.linear_head(df, zero, vec="vec")).first()["loss"]
    assert fitted < 0.5 * base


def test_fit_single_class_threshold_gets_constant_logit(spark):
    df = spark.createDataFrame([([float(i), 1.0], i % 2) for i in range(20)], "vec array<double>, label_idx int")
    h = ordinal.fit_thresholds(df, vec="vec", n_classes=3, max_iter=20)
    assert np.all(h.coef[1] == 0) and h.intercept[1] < -2


def test_head_roundtrip(spark, tmp_path):
    head = OrdinalHead(coef=np.arange(6.0).reshape(2, 3), intercept=np.array([1.0, 2.0]),
                       score_points=[0.0, 0.5, 1.0],
                       blocks=[(np.ones(3), np.zeros(3), np.eye(3), np.zeros(3), None, None)])
    save_head(spark, head, str(tmp_path / "head"))
    back = load_head(spark, str(tmp_path / "head"))
    assert np.allclose(back.coef, head.coef) and np.allclose(back.intercept, head.intercept)
    assert back.score_points == head.score_points and len(back.blocks) == 1
    assert back.blocks[0][4] is None


def test_validate_tolerance_off_when_zero(spark):
    df = spark.createDataFrame([([3.0, -3.0], 1, 1.0), ([-3.0, -3.0], 0, 0.0)],
                               "logits array<double>, label_idx int, label double")
    names = [r["metric"] for r in ordinal.validate(df, [0.0, 1.0, 2.0], tolerance=0.0).collect()]
    assert "val_loss" in names and not any(n.startswith("tolerance") for n in names)


def test_cumulative_targets(spark):
    from rubricon.functions.ordinal import cumulative_targets
    r = spark.range(1).select(cumulative_targets(F.lit(2), 4).alias("t")).first()
    assert r["t"] == [1.0, 1.0, 0.0, 0.0]


def test_vectorised_erf_matches_math():
    xs = np.concatenate([np.linspace(-8, 8, 20001), [0.0, 2.4999999, 2.5, -2.5, 1e-300, 30.0, -30.0]])
    got = ordinal.erf(xs)
    want = np.array([math.erf(v) for v in xs])
    assert np.max(np.abs(got - want)) < 1e-13


def test_numpy_head_null_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, None), (2, [0.0, 1.0])], "id int, vec array<double>")
    head = OrdinalHead(coef=np.array([[1.0, 1.0], [2.0, 0.0]]), intercept=np.array([0.0, 1.0]), score_points=[0, 1, 2])
    got = {r["id"]: r["logits"] for r in ordinal.linear_head(df, head, vec="vec", method="numpy").collect()}
    assert got == {0: [3.0, 3.0], 1: None, 2: [1.0, 1.0]}


def test_decode_numpy_matches_spark(spark):
    rnd = np.random.default_rng(9)
    probs = rnd.random((200, 6))
    probs[::7, 2] = 0.5
    probs[::11, :] = [1.0, 0.0, 1.0, 0.0, 0.0, 0.0]
    probs[5, 3] = float("nan")
    pts = [float(v) / 2 for v in range(7)]
    df = spark.createDataFrame([(i, probs[i].tolist()) for i in range(200)], "i int, p array<double>")
    got = {r["i"]: r["s"] for r in df.select("i", decode_scores("p", pts).alias("s")).collect()}
    want = ordinal.decode_numpy(probs, pts)
    assert all(got[i] == want[i] for i in range(200))


def test_fit_has_no_class_cap(spark):
    df = spark.range(60).select(F.array(F.col("id").cast("double")).alias("vec"), (F.col("id") % 5).cast("int").alias("label_idx"))
    assert ordinal.fit_thresholds(df, vec="vec", max_iter=2).n_thresholds == 4


def test_head_forms_agree_on_nulls_and_reject_short_vectors(spark):
    head = OrdinalHead(coef=np.ones((2, 3)), intercept=np.zeros(2), score_points=[0.0, 1.0, 2.0])
    df = spark.createDataFrame([(0, [1.0, 2.0, 3.0]), (1, None), (2, [1.0, None, 3.0])], "id int, vec array<double>")
    short = spark.createDataFrame([(0, [1.0, 2.0])], "id int, vec array<double>")
    for method in ("numpy", "expr"):
        out = ordinal.decode(ordinal.probabilities(ordinal.head_logits(df, head, "vec", method=method)), head.score_points)
        assert {r["id"]: r["score"] for r in out.collect()} == {0: 2.0, 1: None, 2: None}
        with pytest.raises(Exception, match="vector length"):
            ordinal.head_logits(short, head, "vec", method=method).collect()


def test_one_tie_rule(spark):
    p = [0.5 + 4e-10, 0.5 + 4e-10]
    df = spark.createDataFrame([(p,)], "p array<double>")
    assert df.select(decode_scores("p", [0.0, 1.0, 2.0])).first()[0] == ordinal.decode_numpy([p], [0.0, 1.0, 2.0])[0]


def test_loss_skips_unlabelled_rows(spark):
    df = spark.createDataFrame([([5.0, -5.0], 1), ([5.0, -5.0], None), (None, 1)], "logits array<double>, label_idx int")
    r = ordinal.ordinal_loss(df).first()
    assert r["n_rows"] == 1 and r["n_terms"] == 2 and r["loss"] == pytest.approx(np.log1p(np.exp(-5.0)))
