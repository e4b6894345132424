"""Eval-log analytics and batch scoring."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from rubricon.operators import batch, track
from rubricon.sources.fixtures import toy_factory


def _log(spark, n_runs=3, n=40, seed=0):
    rnd = random.Random(seed)
    rows = [(r, s, round(rnd.uniform(-1, 2), 3)) for r in range(n_runs) for s in range(1, n + 1)]
    return spark.createDataFrame(rows, "run long, step long, metric double"), rows


def _brute_events(rows):
    out, best = set(), {}
    for r, s, m in sorted(rows):
        b = max(0.0, best.get(r, 0.0))
        if m > b:
            out.add((r, s))
        best[r] = max(best.get(r, 0.0), m)
    return out


@pytest.mark.parametrize("chunk", [3, 7, 1000])
def test_improvement_events_chunked(spark, chunk):
    df, rows = _log(spark)
    got = {(r["run"], r["step"]) for r in track.improvement_events(df, chunk_steps=chunk).collect()}
    assert got == _brute_events(rows)


def test_best_checkpoint_earliest_tie_and_none(spark):
    df = spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.9), (1, 3, 0.9), (2, 1, -0.1), (2, 2, 0.0)],
                               "run long, step long, metric double")
    got = {r["run"]: (r["step"], r["metric"]) for r in track.best_checkpoint(df).collect()}
    assert got == {1: (2, 0.9)}


def test_chunked_row_number_equals_row_number(spark):
    rnd = random.Random(1)
    rows = [(rnd.randint(0, 3), rnd.randint(0, 50), i) for i in range(300)]
    df = spark.createDataFrame(rows, "run long, t long, id long")
    a = track.chunked_row_number(df, ["run"], ["t", "id"], F.floor(F.col("t") / 10), out="rn")
    b = df.withColumn("rn", F.row_number().over(Window.partitionBy("run").orderBy("t", "id")))
    assert {tuple(r) for r in a.select("id", "rn").collect()} == {tuple(r) for r in b.select("id", "rn").collect()}


def test_epoch_loss_weighted(spark):
    df = spark.createDataFrame([(1, 0, 1.0, 1), (1, 0, 3.0, 3)], "run long, epoch long, batch_loss double, batch_size long")
    r = track.epoch_loss(df).first()
    assert r["train_loss"] == 2.0 and r["weighted_loss"] == 2.5 and r["n_steps"] == 2


def _answers(spark):
    rows = [(str(i), t) for i, t in enumerate(["abc", None, "  ", "x@y", "hello", "", "ok", "fine", "zz"])]
    return spark.createDataFrame(rows, "BMH string, text string")


def test_batch_score_keyed_batches(spark):
    df = _answers(spark).withColumn("b", (F.col("BMH").cast("int") / 4).cast("int"))
    out = {r["BMH"]: r for r in batch.batch_score(df, toy_factory(), "text", 4, batch_col="b",
                                                  order_cols=["BMH"]).collect()}
    assert len(out) == 9
    assert out["1"]["status"] == "skipped" and out["2"]["status"] == "skipped" and out["5"]["status"] == "skipped"
    for k in ("0", "3"):     # batch 0 holds the marker row: the whole batch fails
        assert out[k]["status"] == "failed" and out[k]["pred_score"] is None and "@" in out[k]["error"]
    assert out["4"]["status"] == "success" and out["4"]["pred_score"] == (5 % 9) / 2
    assert out["8"]["pred_score"] == 1.0


def test_batch_score_isolate_failures(spark):
    df = _answers(spark).coalesce(1)
    out = {r["BMH"]: r["status"] for r in
           batch.batch_score(df, toy_factory(), "text", 16, isolate_failures=True).collect()}
    assert out["3"] == "failed" and out["0"] == "success"
    counts = {r["status"]: r["n"] for r in batch.status_counts(
        batch.batch_score(df, toy_factory(), "text", 16, isolate_failures=True)).collect()}
    assert counts == {"success": 5, "skipped": 3, "failed": 1}


def test_batch_score_default_keeps_every_row(spark):
    df = spark.range(200).select(F.col("id").cast("string").alias("BMH"),
                                 F.when(F.col("id") % 7 == 0, F.lit(None)).otherwise(F.lit("abcd")).alias("text"))
    out = batch.batch_score(df.repartition(3), toy_factory(), "text", 16)
    assert out.count() == 200
    assert out.filter("status = 'success'").count() == 200 - 29


def test_score_one():
    assert batch.score_one("abcdefghij", toy_factory()) == 0.5


def test_batch_score_keyed_large_group_is_chunked(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.range(50).select(F.col("id").cast("string").alias("BMH"), F.lit(1).alias("b"),
                                    F.when(F.col("id") == 20, F.lit("x@")).otherwise(F.lit("abc")).alias("text"))
        out = {int(r["BMH"]): r["status"] for r in
               batch.batch_score(df, toy_factory(), "text", 16, batch_col="b", order_cols=["BMH"]).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(out) == 50
    failed = sorted(k for k, v in out.items() if v == "failed")
    assert len(failed) == 16 and 20 in failed      # only the 16-row chunk holding the marker fails


def test_input_order_batches_like_reference(spark):
    texts = ["a", "", "b", None, "c", "d", "  ", "e", "f", "g"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "row_id long, text string").repartition(3)
    got = {r["row_id"]: r["batch"] for r in batch.input_order_batches(df, ["row_id"], "text", 3).collect()}
    # non-blank rows in input order: 0,2,4,5,7,8,9 -> batches of 3
    assert got == {0: 0, 2: 0, 4: 0, 5: 1, 7: 1, 8: 1, 9: 2, 1: None, 3: None, 6: None}


@pytest.mark.parametrize("limit", [0, 25])
def test_chunked_row_number_hot_chunks(spark, limit):
    rnd = random.Random(2)
    rows = [(0 if i % 3 else rnd.randint(1, 3), rnd.randint(0, 5), i) for i in range(400)]   # run 0 is hot
    df = spark.createDataFrame(rows, "run long, t long, id long")
    a = track.chunked_row_number(df, ["run"], ["t", "id"], F.col("t"), out="rn", max_window_rows=limit)
    b = df.withColumn("rn", F.row_number().over(Window.partitionBy("run").orderBy("t", "id")))
    assert {tuple(r) for r in a.select("id", "rn").collect()} == {tuple(r) for r in b.select("id", "rn").collect()}


def test_input_order_batches_string_order(spark):
    texts = ["a", "", "b", "c"]
    df = spark.createDataFrame([(f"r{i}", t) for i, t in enumerate(texts)], "k string, text string")
    got = {r["k"]: r["batch"] for r in batch.input_order_batches(df, ["k"], "text", 2).collect()}
    assert got == {"r0": 0, "r2": 0, "r3": 1, "r1": None}


def test_chunked_row_number_many_chunks(spark, monkeypatch):
    from rubricon.operators import prepare
    df = spark.range(300).select((F.col("id") * 7 % 300).alias("t"), F.col("id"))
    monkeypatch.setattr(prepare, "MAX_WINDOW_ROWS", 5)
    a = track.chunked_row_number(df, [], ["t"], F.floor(F.col("t") / 4), out="rn", max_window_rows=1000)
    assert sorted((r["t"], r["rn"]) for r in a.collect()) == [(t, t + 1) for t in range(300)]


def test_batch_score_returns_columns_untouched(spark):
    big = 9007199254740993
    df = spark.createDataFrame([(big, "abc", [1, None]), (None, "de", None), (big + 2, " ", [3]), (4, None, [])],
                               "id long, text string, more array<int>")
    got = batch.batch_score(df, toy_factory(), batch_size=2).collect()
    assert sorted((str(r["id"]), r["text"], str(r["more"]), r["status"]) for r in got if r["text"]) == [
        (str(big), "abc", "[1, None]", "success"), (str(big + 2), " ", "[3]", "skipped"), ("None", "de", "None", "success")]
    assert len(got) == 4


def test_batch_score_spreads_rows_without_batch(spark):
    df = spark.range(4000).select("id", F.when(F.col("id") % 3 == 0, " ").otherwise("abc").alias("text"),
                                  F.when(F.col("id") % 2 == 0, F.floor(F.col("id") / 8)).alias("batch"))
    out = batch.batch_score(df, toy_factory(), batch_size=16, batch_col="batch", order_cols=["id"])
    assert {r["status"]: r["count"] for r in out.groupBy("status").count().collect()} == {"skipped": 1334, "success": 2666}
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(coalesce)
    spark.conf.set(coalesce, "false")       # tiny partitions would be put together
    try:
        for part in (out.where("status = 'skipped'"), out.where("status = 'success' and batch is null")):
            assert part.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    finally:
        spark.conf.set(coalesce, before)


def test_input_order_batches_keeps_rows_without_order(spark):
    df = spark.createDataFrame([(None, "a"), (2, "b"), (1, "c"), (None, " ")], "row_id long, text string")
    got = batch.input_order_batches(df, ["row_id"], "text", 2).collect()
    assert sorted((r["text"], r["batch"]) for r in got if r["text"] != " ") == [("a", 0), ("b", 1), ("c", 0)] and len(got) == 4
