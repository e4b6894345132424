"""Every size switch with its limit at 1 gives the rows of the other path, null groups among them."""

import pytest
from pyspark.sql import functions as F

from rubricon.operators import agree, ordinal, pool, prepare, profile, track


@pytest.fixture(scope="module")
def df(spark):
    """100 rows in two groups of 50, one of them null."""
    i = F.col("id")
    return spark.range(100).select(F.when(i % 2 == 0, "a").alias("g"), i.alias("x"), i.cast("string").alias("BMH"), (i % 7).cast("double").alias("pred"),
                                   (i % 5).cast("double").alias("label"), ((i * 37) % 101).cast("double").alias("v")).repartition(5)


def rows(d):
    return sorted(repr(tuple(round(v, 9) if isinstance(v, float) else v for v in r)) for r in d.collect())


def both(monkeypatch, f, modules=(prepare, profile)):
    usual = rows(f())
    for m in modules:
        monkeypatch.setattr(m, "MAX_WINDOW_ROWS", 1)
    assert rows(f()) == usual
    return usual


def test_exact_rank_keeps_null_groups(df):
    got = prepare.exact_rank(df, ["g"], ["x"]).collect()
    assert len(got) == 100
    assert sorted(r["_rank"] for r in got if r["g"] is None) == list(range(1, 51))


def test_global_rank(df):
    usual = rows(prepare.global_rank(df, ["x"], 3, partition_cols=["g"]))
    assert len(usual) == 100
    assert rows(prepare.global_rank(df, ["x"], 3, partition_cols=["g"], max_window_rows=1)) == usual
    assert rows(prepare.global_rank(df, ["x"], 3, partition_cols=["g"], max_window_rows=0)) == usual


def test_global_rank_without_a_list_of_hot_buckets(df, monkeypatch):
    usual = rows(prepare.global_rank(df, ["x"], 3, partition_cols=["g"]))
    monkeypatch.setattr(prepare, "MAX_HOT_BUCKETS", 1)
    assert rows(prepare.global_rank(df, ["x"], 3, partition_cols=["g"], max_window_rows=0)) == usual


@pytest.mark.parametrize("share", [0.0, 0.2, 0.33, 1.0])
def test_split(df, share):
    copies = df.unionByName(df.filter("x < 20")).unionByName(df.filter("x in (4, 5)").withColumn("v", F.col("v") + 1))
    usual = rows(prepare.split_exact(copies, ["BMH"], share, group_cols=["g"]))
    assert len(usual) == 122 and sum("'test'" in r for r in usual) == 2 * -(-61 * share // 1)
    assert rows(prepare.split_exact(copies, ["BMH"], share, group_cols=["g"], max_window_rows=1)) == usual
    assert len(rows(prepare.split_exact(copies.withColumn("BMH", F.lit(None).cast("string")), ["BMH"], share))) == 122


def test_score_points_and_encoding(df, monkeypatch):
    usual = both(monkeypatch, lambda: prepare.score_points(df, "label", ["g"]))
    assert len(usual) == 10
    both(monkeypatch, lambda: prepare.encode_ordinal(df, "label", ["g"])[0])
    assert prepare.score_points_preview(prepare.score_points(df, "label", ["g"]), ["g"], 2, 1).count() == 10


def test_metrics(df, monkeypatch):
    usual = both(monkeypatch, lambda: agree.compute_metrics(df, group_cols=["g"], tolerance=1.0))
    assert len(usual) == 20
    both(monkeypatch, lambda: agree.tolerance_qwk(df, 1.0, group_cols=["g"]))
    both(monkeypatch, lambda: agree.spearman(df, group_cols=["g"]))


def test_describe(df, monkeypatch):
    usual = rows(profile.describe(df, "v", ["g"]))
    assert len(usual) == 2
    assert rows(profile.describe(df, "v", ["g"], max_window_rows=1)) == usual
    one = rows(profile.describe(df, "v"))
    assert rows(profile.describe(df, "v", max_window_rows=1)) == one


def test_describe_inside_brackets(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    values = np.concatenate([rng.normal(size=4000), np.full(900, 0.25), rng.integers(0, 3, 600)])
    data = spark.createDataFrame([(None if i % 3 else "a", float(v)) for i, v in enumerate(values)], "g string, v double").repartition(6)
    for accuracy, limit in ((20, prepare.MAX_WINDOW_ROWS), (50, 1), (10_000, prepare.MAX_WINDOW_ROWS)):
        for g in ([], ["g"]):
            for r in profile.describe(data, "v", g, accuracy=accuracy, max_window_rows=limit).collect():
                own = values if not g else values[[(i % 3 == 0) == (r["g"] == "a") for i in range(len(values))]]
                assert r["count"] == len(own) and r["std"] == pytest.approx(own.std(ddof=1))
                for p in profile.PERCENTILES:
                    assert r[profile.pct_name(p)] == pytest.approx(np.quantile(own, p), abs=1e-12), (accuracy, g, p)


def test_validate(df, monkeypatch):
    d = df.select("g", "label", F.col("label").cast("int").alias("label_idx"), F.array(*[F.col("pred") - k for k in range(4)]).alias("logits"))
    both(monkeypatch, lambda: ordinal.validate(d, [0.0, 1.0, 2.0, 3.0, 4.0], tolerance=1.0, group_cols=["g"]))


def test_row_numbers(df, monkeypatch):
    number = lambda: track.chunked_row_number(df, ["g"], ["x"], F.floor(F.col("x") / 30))
    usual = both(monkeypatch, number)
    assert len(usual) == 100
    assert rows(track.chunked_row_number(df, ["g"], ["x"], F.floor(F.col("x") / 30), max_window_rows=1)) == usual


def test_positions(df):
    usual = rows(pool.with_positions(df.select("g", "x"), "g", "x"))
    assert len(usual) == 100 and rows(pool.with_positions(df.select("g", "x"), "g", "x", most_rows=7)) == usual
    text = df.select("g", F.lpad("BMH", 3, "0").alias("t"))
    assert rows(pool.with_positions(text, "g", "t", most_rows=7)) == rows(pool.with_positions(text, "g", "t"))


def test_no_epochs_is_an_error(df):
    for bad in ({"epochs": 0}, {"epochs": -1}, {"batch_size": 0}):
        with pytest.raises(ValueError):
            prepare.shuffled_batches(df, ["BMH"], **bad)


def test_padding_in_batches(spark):
    data = [(0, [1, 2]), (0, [1, 2, 3, 4, 5, 6]), (1, [7]), (1, []), (1, None), (None, [1, 2, 3]), (None, [4]), (None, None), (2, None)]
    d = spark.createDataFrame(data, "b int, t array<int>")
    for side in ("right", "left"):
        got = sorted((str(r["b"]), str(r["t"]), r["input_ids"], r["attention_mask"]) for r in prepare.pad_truncate(d, "t", 4, -1, side, "b").collect())
        want = []
        for b, t in data:
            if t is None:
                want.append((str(b), "None", None, None))
                continue
            width = min(4, len(t) if b is None else max(len(o) for k, o in data if k == b and o is not None))
            kept = t[:4]
            pad, no = [-1] * (width - len(kept)), [0] * (width - len(kept))
            one = [1] * len(kept)
            want.append((str(b), str(t), kept + pad if side == "right" else pad + kept, one + no if side == "right" else no + one))
        assert got == sorted(want)


def test_borders_below(spark):
    """Chunks are found by bisection in compiled code: no lambda tests every border for every row."""
    cuts = [1.0, 2.0, 2.0, 5.0, 8.0]
    df = spark.createDataFrame([(x, cuts[:n]) for n in range(6) for x in (0.0, 1.0, 1.5, 2.0, 3.0, 8.0, 9.0, float("nan"), None)], "x double, b array<double>")
    got = pool._borders_below(df, "b", "x", 5, "n").collect()
    assert all(r["n"] == sum(c < r["x"] or r["x"] != r["x"] for c in r["b"]) if r["x"] is not None else r["n"] == 0 for r in got)
    placed = pool.with_positions(spark.range(300).select(F.lit(None).cast("string").alias("g"), F.col("id").alias("x")), "g", "x", most_rows=7)
    assert sorted((r["x"], r["pos"]) for r in placed.collect()) == [(i, i) for i in range(300)]
    assert "lambda" not in placed._jdf.queryExecution().toString()
