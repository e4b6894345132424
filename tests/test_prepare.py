"""Sources and prepare: calibration union (T1, T2, T15), join (T7), encoding, splits, batches, padding."""

import math
import os

import pytest
from pyspark.sql import functions as F

from rubricon.operators import prepare
from rubricon.sources.answers import load_answers, require_columns
from rubricon.sources.calibration import load_calibration


def _write(path, text):
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def test_calibration_union_by_name(spark, tmp_path):
    d = tmp_path / "calibration"
    d.mkdir()
    _write(d / "calibration1_8.csv", "BMH,ZZCJ,other\n001,2.0,x\n002,3.5,y\n")
    _write(d / "calibration2_8.csv", "ZZCJ,BMH\n1.5,003\nNA,004\n")
    _write(d / "calibration1_9.csv", "BMH,ZZCJ\n005,1\n")
    got = {r["BMH"]: r["label"] for r in load_calibration(spark, f"{d}/calibration*_8.csv").collect()}
    assert got == {"001": 2.0, "002": 3.5, "003": 1.5}     # leading zeros kept, NA dropped, by name


def test_calibration_missing_raises(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        load_calibration(spark, f"{tmp_path}/nothing*_8.csv")


def test_calibration_bad_number_fails(spark, tmp_path):
    _write(tmp_path / "c_1.csv", "BMH,ZZCJ\n1,abc\n")
    with pytest.raises(Exception):
        load_calibration(spark, f"{tmp_path}/c_*.csv").collect()


def test_answers_drop_only_null(spark):
    raw = spark.createDataFrame([(1, "a"), (2, None), (3, "  ")], "BMH int, `OCR文字结果` string")
    got = {r["BMH"]: r["text"] for r in load_answers(raw).collect()}
    assert got == {"1": "a", "3": "  "}
    with pytest.raises(ValueError):
        require_columns(raw, ["BMH", "missing"])


def test_join_many_to_many_and_encode(spark):
    ans = spark.createDataFrame([("1", "a"), ("2", "b")], "BMH string, text string")
    cal = spark.createDataFrame([("1", 2.0), ("1", 0.5), ("2", 4.0), ("9", 1.0)], "BMH string, label double")
    j = prepare.join_labels(ans, cal)
    assert j.count() == 3
    out, pts = prepare.encode_ordinal(j)
    got = sorted((r["BMH"], r["label"], r["label_idx"]) for r in out.collect())
    assert got == [("1", 0.5, 0), ("1", 2.0, 1), ("2", 4.0, 2)]
    assert prepare.duplicate_keys(cal).collect()[0]["BMH"] == "1"


def test_encode_plan_broadcasts_lookup(spark):
    df = spark.createDataFrame([(str(i), float(i % 5)) for i in range(100)], "BMH string, label double")
    out, _ = prepare.encode_ordinal(df)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan


def _split_set(df):
    return {(r["BMH"], r["split"]) for r in df.collect()}


def test_split_exact_sizes_and_repeatable(spark):
    df = spark.createDataFrame([(str(i), float(i % 3)) for i in range(997)], "BMH string, label double")
    a = prepare.split_exact(df, ["BMH"], 0.2, 42)
    s = _split_set(a)
    assert len(s) == 997
    assert sum(1 for _, sp in s if sp == "test") == math.ceil(997 * 0.2)
    b = prepare.split_exact(df.repartition(7), ["BMH"], 0.2, 42)
    c = prepare.split_exact(df.coalesce(1), ["BMH"], 0.2, 42)
    assert _split_set(b) == s and _split_set(c) == s
    assert _split_set(prepare.split_exact(df, ["BMH"], 0.2, 7)) != s


def test_split_matches_global_order(spark):
    df = spark.createDataFrame([(str(i),) for i in range(300)], "BMH string")
    got = {r["BMH"] for r in prepare.split_exact(df, ["BMH"], 0.25, 42).filter("split = 'test'").collect()}
    import hashlib
    order = sorted((hashlib.md5(f"42:{i}".encode()).hexdigest(), str(i)) for i in range(300))
    assert got == {k for _, k in order[:75]}


def test_split_by_group(spark):
    rows = [("g1", str(i)) for i in range(11)] + [("g2", str(i)) for i in range(100, 130)]
    df = spark.createDataFrame(rows, "g string, BMH string")
    c = {(r["g"], r["split"]): r["n"] for r in
         prepare.split_exact(df, ["BMH"], 0.2, 42, group_cols=["g"]).groupBy("g", "split").agg(
             F.count(F.lit(1)).alias("n")).collect()}
    assert c[("g1", "test")] == 3 and c[("g2", "test")] == 6 and c[("g1", "train")] == 8


def test_shuffled_batches_complete(spark):
    df = spark.createDataFrame([(str(i),) for i in range(70)], "BMH string")
    b = prepare.shuffled_batches(df, ["BMH"], batch_size=16, epochs=2, seed=1).collect()
    for e in (0, 1):
        rows = [r for r in b if r["epoch"] == e]
        assert len(rows) == 70
        sizes = {}
        for r in rows:
            sizes[r["batch_id"]] = sizes.get(r["batch_id"], 0) + 1
        assert sorted(sizes.values()) == [6, 16, 16, 16, 16]
        assert len({(r["batch_id"], r["batch_pos"]) for r in rows}) == 70
    e0 = sorted((r["batch_id"], r["batch_pos"], r["BMH"]) for r in b if r["epoch"] == 0)
    e1 = sorted((r["batch_id"], r["batch_pos"], r["BMH"]) for r in b if r["epoch"] == 1)
    assert [x[2] for x in e0] != [x[2] for x in e1]


def test_pad_truncate_sides(spark):
    df = spark.createDataFrame([([5, 6, 7],), ([1, 2, 3, 4, 5, 6],)], "t array<int>")
    r = prepare.pad_truncate(df, "t", 4).collect()
    assert r[0]["input_ids"] == [5, 6, 7, 0] and r[0]["attention_mask"] == [1, 1, 1, 0]
    assert r[1]["input_ids"] == [1, 2, 3, 4] and r[1]["attention_mask"] == [1, 1, 1, 1]
    left = prepare.pad_truncate(df, "t", 4, pad_id=9, side="left").collect()
    assert left[0]["input_ids"] == [9, 5, 6, 7] and left[0]["attention_mask"] == [0, 1, 1, 1]


def _skewed(spark):
    """One key with 400 exact copies plus 300 copies differing in text, and 500 distinct keys."""
    rows = [("hot", "same", 1.0)] * 400 + [("hot", f"t{i}", 2.0) for i in range(300)]
    rows += [(str(i), f"x{i}", float(i % 4)) for i in range(500)]
    return spark.createDataFrame(rows, "BMH string, text string, label double").repartition(6)


def test_split_hot_bucket_path_equals_window_path(spark):
    df = _skewed(spark)
    for ts in (0.2, 0.5, 0.7):
        a = sorted(tuple(r) for r in prepare.split_exact(df, ["BMH"], ts, 42, tiebreak_cols=["text"]).collect())
        b = sorted(tuple(r) for r in prepare.split_exact(df, ["BMH"], ts, 42, tiebreak_cols=["text"],
                                                        max_window_rows=0).collect())
        assert a == b
        assert sum(1 for r in a if r[-1] == "test") == math.ceil(1200 * ts)


def test_global_rank_hot_path_equals_window_path(spark):
    df = _skewed(spark)
    a = prepare.global_rank(df, ["BMH"], 42).collect()
    b = prepare.global_rank(df, ["BMH"], 42, max_window_rows=0).collect()
    assert sorted(r["rank"] for r in b) == list(range(1, 1201))
    assert sorted(tuple(r) for r in a) == sorted(tuple(r) for r in b)


def test_exact_rank_spreads_copies(spark):
    df = spark.createDataFrame([("k", 1)] * 1000, "k string, v int")
    r = prepare.exact_rank(df, [], ["k", "v"], "rk", n_parts=4)
    assert sorted(x["rk"] for x in r.collect()) == list(range(1, 1001))


def test_answers_na_tokens(spark):
    from rubricon.sources.calibration import PANDAS_NA_TOKENS
    raw = spark.createDataFrame([(1, "None"), (2, "fine"), (3, "NA")], "BMH int, text string")
    assert load_answers(raw, text_col="text").count() == 3
    got = [r["BMH"] for r in load_answers(raw, text_col="text", na_tokens=PANDAS_NA_TOKENS).collect()]
    assert got == ["2"]


def test_encode_many_points_uses_ranked_lookup(spark, monkeypatch):
    df = spark.createDataFrame([(str(i), float(i % 37) / 3) for i in range(300)], "BMH string, label double")
    small, _ = prepare.encode_ordinal(df)
    no_broadcast, _ = prepare.encode_ordinal(df, max_broadcast_rows=5)
    monkeypatch.setattr(prepare, "MAX_WINDOW_ROWS", 0)
    ranked, _ = prepare.encode_ordinal(df)
    a = sorted((r["BMH"], r["label_idx"]) for r in small.collect())
    b = sorted((r["BMH"], r["label_idx"]) for r in no_broadcast.collect())
    c = sorted((r["BMH"], r["label_idx"]) for r in ranked.collect())
    assert a == b == c and max(x[1] for x in a) == 36


def test_rank_paths_when_every_bucket_is_large(spark, monkeypatch):
    """More hot buckets than the collect cap: everything is ranked by one balanced sort."""
    monkeypatch.setattr(prepare, "MAX_HOT_BUCKETS", 2)
    df = _skewed(spark)
    a = sorted(tuple(r) for r in prepare.global_rank(df, ["BMH"], 42).collect())
    b = sorted(tuple(r) for r in prepare.global_rank(df, ["BMH"], 42, max_window_rows=0).collect())
    assert a == b
    rows = [("g%d" % (i % 5), str(i), float(i % 3)) for i in range(400)]
    g = spark.createDataFrame(rows, "grp string, BMH string, label double")
    x = sorted(tuple(r) for r in prepare.split_exact(g, ["BMH"], 0.3, 42, group_cols=["grp"]).collect())
    y = sorted(tuple(r) for r in prepare.split_exact(g, ["BMH"], 0.3, 42, group_cols=["grp"],
                                                    max_window_rows=0).collect())
    assert x == y


def test_pad_to_longest_in_batch(spark):
    df = spark.createDataFrame([(0, [1, 2]), (0, [1, 2, 3, 4, 5, 6]), (1, [7]), (1, [8, 9])],
                               "b int, t array<int>")
    r = sorted(((x["b"], x["input_ids"], x["attention_mask"]) for x in
                prepare.pad_truncate(df, "t", 4, batch_col="b").collect()), key=lambda v: (v[0], v[1]))
    assert r == [(0, [1, 2, 0, 0], [1, 1, 0, 0]), (0, [1, 2, 3, 4], [1, 1, 1, 1]),
                 (1, [7, 0], [1, 0]), (1, [8, 9], [1, 1])]
