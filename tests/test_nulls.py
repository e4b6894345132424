"""Null keys, unmeasured steps, unlabelled rows and null elements: defined results, no row lost."""

import pytest
from pyspark.sql import functions as F

from rubricon import jobs
from rubricon.functions.ordinal import decode_scores
from rubricon.operators import agree, ordinal, prepare, profile, track


def test_split_and_encode_keep_null_groups(spark):
    df = spark.range(100).select(F.col("id").cast("string").alias("BMH"), F.when(F.col("id") % 2 == 0, "a").alias("g"),
                                 (F.col("id") % 3).cast("double").alias("label"))
    out = prepare.split_exact(df, group_cols=["g"])
    assert {(r["g"], r["split"]): r["count"] for r in out.groupBy("g", "split").count().collect()} == {
        ("a", "test"): 10, ("a", "train"): 40, (None, "test"): 10, (None, "train"): 40}
    coded, _ = prepare.encode_ordinal(df, group_cols=["g"])
    assert coded.count() == 100 and coded.where("label_idx is null").count() == 0


def test_row_number_of_null_runs(spark):
    df = spark.createDataFrame([("a", 1), (None, 1), (None, 2)], "run string, step long")
    got = track.chunked_row_number(df, ["run"], ["step"], F.floor(F.col("step") / 10))
    assert sorted((str(r["run"]), r["step"], r["rn"]) for r in got.collect()) == [("None", 1, 1), ("None", 2, 2), ("a", 1, 1)]


def test_steps_without_metric(spark):
    nan = float("nan")
    log = spark.createDataFrame([("a", 1, None), ("a", 2, 0.7), ("a", 3, 0.9), ("b", 1, nan), ("b", 2, None), ("c", 1, nan), ("c", 2, 0.2), (None, 1, 0.5)],
                                "run string, step long, metric double")
    assert sorted((str(r["run"]), r["step"]) for r in track.best_checkpoint(log).collect()) == [("None", 1), ("a", 3), ("c", 2)]
    assert sorted((str(r["run"]), r["step"]) for r in track.improvement_events(log).collect()) == [("None", 1), ("a", 2), ("a", 3), ("c", 2)]


def test_unlabelled_rows_have_no_loss(spark):
    rows = [([5.0, -5.0], 1.0, 1), ([5.0, -5.0], None, None)]
    df = spark.createDataFrame(rows, "logits array<double>, label double, label_idx int")
    both, one = (ordinal.validate(x, [0.0, 1.0, 2.0]).where("metric = 'val_loss'").first()["value"] for x in (df, df.limit(1)))
    assert both == pytest.approx(one)


def test_null_elements_do_not_decode(spark):
    df = spark.createDataFrame([([None, None],), ([0.9, 0.1],), (None,)], "p array<double>")
    assert [r[0] for r in df.select(decode_scores("p", [0.0, 1.0, 2.0])).collect()] == [None, 1.0, None]


def test_score_table_csv(spark, tmp_path):
    df = spark.createDataFrame([("1", 'a "quoted"\nline'), ("2", "")], "BMH string, text string")
    back, counts = jobs.score_table(df, lambda: (lambda texts: [1.0] * len(texts)), str(tmp_path / "out"), fmt="csv")
    got = {r["BMH"]: r for r in back.collect()}
    assert got["1"]["text"] == 'a "quoted"\nline' and counts.count() == 2


def test_null_groups_in_metrics_and_profiles(spark):
    df = spark.range(40).select(F.when(F.col("id") % 2 == 0, "a").alias("g"), (F.col("id") % 5).cast("double").alias("pred"),
                                (F.col("id") % 3).cast("double").alias("label"))
    whole = {r["metric"]: r["value"] for r in agree.compute_metrics(df.where("g is null"), tolerance=1.0).collect()}
    got = {r["metric"]: r["value"] for r in agree.compute_metrics(df, group_cols=["g"], tolerance=1.0).where("g is null").collect()}
    assert got == pytest.approx(whole) and len(got) == 10
    assert {r["g"]: r["count"] for r in profile.describe(df, "pred", ["g"]).collect()} == {"a": 20, None: 20}
    hist = profile.histogram(df, "pred", 4, ["g"]).groupBy("g").agg(F.count("*").alias("bins"), F.sum("n").alias("n"))
    assert {r["g"]: (r["bins"], r["n"]) for r in hist.collect()} == {"a": (4, 20), None: (4, 20)}


def test_profiles_of_no_values(spark):
    df = spark.createDataFrame([(None,), (float("nan"),)], "x double")
    assert profile.histogram(df, "x", 4).count() == 0 and profile.describe(df, "x").count() == 0
