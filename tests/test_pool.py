"""Pooling: golden examples, method equivalence, errors."""

import numpy as np
import pytest

from rubricon.operators import pool

VECS = [[1.0, 2.0], [3.0, 4.0], [5.0, 6.0], [7.0, 8.0]]


def _tokens(spark, masks):
    rows = [(s, p, m, VECS[p]) for s, mask in enumerate(masks) for p, m in enumerate(mask)]
    return spark.createDataFrame(rows, "seq_id long, pos int, mask int, vec array<double>")


def _get(df):
    return {r["seq_id"]: [round(v, 6) for v in r["pooled"]] for r in df.collect()}


def test_golden_mean_last_attention(spark):
    t = _tokens(spark, [[1, 1, 1, 0], [0, 0, 0, 0]])
    assert _get(pool.pool_mean(t)) == {0: [3.0, 4.0], 1: [0.0, 0.0]}
    assert _get(pool.pool_last(t)) == {0: [5.0, 6.0], 1: [7.0, 8.0]}
    assert _get(pool.pool_attention(t, [1.0, 0.0])) == {0: [4.701874, 5.701874], 1: [4.0, 5.0]}


def test_methods_agree(spark):
    rnd = np.random.default_rng(2)
    rows = [(s, p, int(rnd.random() < 0.7), rnd.normal(size=5).tolist()) for s in range(6) for p in range(9)]
    t = spark.createDataFrame(rows, "seq_id long, pos int, mask int, vec array<double>")
    a = {k: np.array(v) for k, v in _get(pool.pool_mean(t, method="summarizer")).items()}
    b = {k: np.array(v) for k, v in _get(pool.pool_mean(t, method="explode")).items()}
    assert a.keys() == b.keys() and all(np.allclose(a[k], b[k]) for k in a)
    q = [0.3, -0.2, 0.1, 0.0, 1.0]
    a = {k: np.array(v) for k, v in _get(pool.pool_attention(t, q, method="states")).items()}
    b = {k: np.array(v) for k, v in _get(pool.pool_attention(t, q, method="explode")).items()}
    assert all(np.allclose(a[k], b[k]) for k in a)


def test_mean_of_ones_is_ones(spark):
    rows = [(0, p, 1 if p < 3 else 0, [1.0] * 4) for p in range(5)]
    t = spark.createDataFrame(rows, "seq_id long, pos int, mask int, vec array<double>")
    assert _get(pool.pool_mean(t)) == {0: [1.0] * 4}


def test_last_uses_mask_sum_not_last_one(spark):
    t = _tokens(spark, [[1, 1, 1, 0], [1, 0, 1, 0]])
    assert _get(pool.pool_last(t)) == {0: [5.0, 6.0], 1: [3.0, 4.0]}


def test_missing_mask_means_all_real(spark):
    rows = [(0, p, VECS[p]) for p in range(4)]
    t = spark.createDataFrame(rows, "seq_id long, pos int, vec array<double>")
    assert _get(pool.pool_mean(t, mask=None)) == {0: [4.0, 5.0]}
    assert _get(pool.pool_last(t, mask=None)) == {0: [7.0, 8.0]}


def test_unknown_strategy_raises(spark):
    t = _tokens(spark, [[1, 1, 1, 1]])
    with pytest.raises(ValueError):
        pool.pool(t, "max")


def test_with_positions_chunked(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([(s, t) for s in range(3) for t in range(0, 200, 3)], "seq_id long, token_order long")
    a = pool.with_positions(df)
    b = pool.with_positions(df, chunk=F.floor(F.col("token_order") / 10))
    assert sorted(tuple(r) for r in a.collect()) == sorted(tuple(r) for r in b.collect())
