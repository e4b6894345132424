"""End-to-end jobs, sinks and partition pruning."""

import numpy as np
from pyspark.sql import functions as F

from rubricon import jobs
from rubricon.operators import batch, prepare
from rubricon.sources.answers import read_question, write_by_question
from rubricon.sources.sinks import OrdinalHead, load_head
from rubricon.sources.fixtures import toy_factory

SF = "/root/testdata/sf0.001"


def test_fit_and_validate_end_to_end(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    v = e.select(F.col("vec_id").cast("string").alias("BMH"), F.col("embedding").cast("array<double>").alias("pooled"),
                 F.col("label").cast("double").alias("label"), F.col("label").alias("label_idx"))
    v = prepare.split_exact(v, ["BMH"], 0.2, 42)
    head, metrics = jobs.fit_and_validate(v, [float(i) for i in range(10)], tolerance=1.0, max_iter=30,
                                          output=str(tmp_path / "out"))
    names = {r["metric"] for r in metrics.collect()}
    assert {"qwk", "val_loss", "tolerance_acc(1.0)"} <= names
    back = load_head(spark, str(tmp_path / "out/model"))
    assert np.allclose(back.coef, head.coef)
    assert spark.read.json(str(tmp_path / "out/metrics")).count() == len(names)


def test_score_sequences_with_features(spark):
    rows = [(s, p, 1, [float(s), float(p)]) for s in range(3) for p in range(4)]
    t = spark.createDataFrame(rows, "seq_id long, pos int, mask int, vec array<double>")
    f = spark.createDataFrame([(s, [1.0]) for s in range(3)], "seq_id long, features array<double>")
    head = OrdinalHead(coef=np.array([[1.0, 0.0, -0.5], [1.0, 0.0, -1.5]]), intercept=np.zeros(2),
                       score_points=[0.0, 1.0, 2.0])
    got = {r["seq_id"]: r["score"] for r in jobs.score_sequences(t, head, features=f).collect()}
    assert got == {0: 0.0, 1: 1.0, 2: 2.0}


def test_score_table_writes_and_counts(spark, tmp_path):
    df = spark.createDataFrame([("1", "abc"), ("2", None), ("3", "a@b")], "BMH string, text string").coalesce(1)
    scored, counts = jobs.score_table(df, toy_factory(), str(tmp_path / "scored"), batch_size=1)
    assert {r["status"]: r["n"] for r in counts.collect()} == {"success": 1, "skipped": 1, "failed": 1}
    assert scored.count() == 3


def test_profile_table(spark):
    df = spark.createDataFrame([("ab", 1.0), ("", None), (None, 2.0)], "text string, pred_score double")
    out = jobs.profile_table(df)
    assert out["length_describe"].first()["count"] == 3
    assert out["score_describe"].first()["count"] == 2
    assert out["length_vs_score"].count() == 2          # rows with a score (T9)


def test_read_question_prunes_partitions(spark, tmp_path):
    df = spark.createDataFrame([("101", "8", "1", "a"), ("101", "9", "2", "b"), ("102", "8", "3", "c")],
                               "subject_id string, question_id string, BMH string, text string")
    write_by_question(df, str(tmp_path / "ans"))
    q = read_question(spark, str(tmp_path / "ans"), "101", "8")
    assert [r["BMH"] for r in q.collect()] == ["1"]
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(subject_id" in plan or "PartitionFilters: [" in plan


def test_agreement_report(spark):
    df = spark.createDataFrame([(0.0, 0.0), (2.0, 2.0), (4.0, 3.0), (4.0, 4.0), (1.0, 1.0)], "pred double, label double")
    rep = jobs.agreement_report(df, tolerance=1.0)
    m = {r["metric"]: r["value"] for r in rep["metrics"].collect()}
    assert m["exact_accuracy"] == 0.8 and round(m["qwk"], 6) == 0.956522
    assert rep["tolerance_curve"].count() == 16


def test_encode_examples(spark):
    df = spark.createDataFrame([("1", "ab c", 1.0, 1)], "BMH string, text string, label double, label_idx int")
    ex = prepare.encode_examples(df.withColumn("tok", prepare.word_lengths("text")), "tok", 4).first()
    assert ex["input_ids"] == [2, 1, 0, 0] and ex["attention_mask"] == [1, 1, 0, 0] and ex["label_idx"] == 1


def test_write_scored_restores_order(spark, tmp_path):
    from rubricon.sources.sinks import write_scored
    import glob
    import pandas as pd
    df = spark.createDataFrame([(i, str(i)) for i in (5, 3, 9, 1, 7, 2, 8)], "row_id int, BMH string").repartition(3)
    write_scored(df, str(tmp_path / "o"), order_col="row_id")
    files = sorted(glob.glob(str(tmp_path / "o" / "*.parquet")))
    got = [v for f in files for v in pd.read_parquet(f)["row_id"].tolist()]
    assert got == [1, 2, 3, 5, 7, 8, 9]


def test_cli_agree_and_score(spark, tmp_path):
    from rubricon import cli
    df = spark.createDataFrame([(0.0, 0.0), (2.0, 2.0), (4.0, 3.0), (4.0, 4.0), (1.0, 1.0)], "pred double, label double")
    df.write.parquet(str(tmp_path / "in"))
    assert cli.main(["agree", "--input", str(tmp_path / "in"), "--output", str(tmp_path / "m")]) == 0
    m = {r["metric"]: r["value"] for r in spark.read.json(str(tmp_path / "m")).collect()}
    assert m["exact_accuracy"] == 0.8
    a = spark.createDataFrame([("1", "abc"), ("2", None)], "BMH string, text string")
    a.write.parquet(str(tmp_path / "ans"))
    assert cli.main(["score", "--input", str(tmp_path / "ans"), "--output", str(tmp_path / "out"),
                     "--scorer", "rubricon.sources.fixtures:ToyScorer", "--text-col", "text"]) == 0
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_cli_fit(spark, tmp_path):
    from rubricon import cli
    e = spark.read.parquet(f"{SF}/embeddings.parquet").select(
        F.col("vec_id").cast("string").alias("BMH"), F.col("embedding").cast("array<double>").alias("pooled"),
        F.col("label").cast("double").alias("label"))
    e.write.parquet(str(tmp_path / "v"))
    assert cli.main(["fit", "--vectors", str(tmp_path / "v"), "--output", str(tmp_path / "o"),
                     "--max-iter", "20", "--tolerance", "1.0"]) == 0
    assert spark.read.parquet(str(tmp_path / "o/model/weights")).count() == 9


def test_reference_layout(spark):
    from rubricon.sources.sinks import to_reference_layout
    df = spark.createDataFrame([("1", "a", 1.0, "success", None), ("2", None, None, "skipped", None),
                                ("3", "x", None, "failed", "boom")],
                               "BMH string, text string, pred_score double, status string, error string")
    out = {r["BMH"]: r for r in to_reference_layout(df).collect()}
    assert out["1"]["处理状态"] == "成功" and out["1"]["预测分数"] == 1.0
    assert out["2"]["处理状态"] == "跳过(空文本)"
    assert out["3"]["处理状态"] == "失败: boom"


def test_ordinal_text_scorer_in_batch_score(spark):
    def embed_factory():
        def embed(texts):
            if any("@" in t for t in texts):
                raise ValueError("backbone failed")
            return np.array([[len(t), t.count("a")] for t in texts], dtype=float)
        return embed
    head = OrdinalHead(coef=np.array([[1.0, 0.0], [1.0, 0.0]]), intercept=np.array([-2.5, -4.5]),
                       score_points=[0.0, 1.0, 2.0])
    assert batch.score_one("abcdef", jobs.ordinal_text_scorer(embed_factory, head)) == 2.0
    factory = jobs.ordinal_text_scorer(embed_factory, head, spark)
    assert batch.score_one("a", factory) == 0.0
    df = spark.createDataFrame([("1", "abc"), ("2", "x@"), ("3", None)], "BMH string, text string").coalesce(1)
    out = {r["BMH"]: (r["pred_score"], r["status"]) for r in
           batch.batch_score(df, factory, "text", 1).collect()}
    assert out == {"1": (1.0, "success"), "2": (None, "failed"), "3": (None, "skipped")}


def embed_lengths():
    """Toy backbone for the CLI test: one feature, the text length."""
    return lambda texts: np.array([[float(len(t))] for t in texts])


def test_cli_score_with_head(spark, tmp_path):
    from rubricon import cli
    from rubricon.sources.sinks import save_head
    head = OrdinalHead(coef=np.array([[1.0], [1.0]]), intercept=np.array([-2.5, -4.5]), score_points=[0.0, 1.0, 2.0])
    save_head(spark, head, str(tmp_path / "h"))
    spark.createDataFrame([("1", "abcdef"), ("2", "a")], "BMH string, text string").write.parquet(str(tmp_path / "a"))
    assert cli.main(["score", "--input", str(tmp_path / "a"), "--output", str(tmp_path / "o"), "--text-col", "text",
                     "--scorer", "tests.test_jobs:embed_lengths", "--head", str(tmp_path / "h")]) == 0
    got = {r["BMH"]: r["pred_score"] for r in spark.read.parquet(str(tmp_path / "o")).collect()}
    assert got == {"1": 2.0, "2": 0.0}


def test_cli_profile(spark, tmp_path):
    from rubricon import cli
    df = spark.createDataFrame([("ab", 1.0), ("", None), (None, 2.0), ("abcd", 1.5)], "text string, pred_score double")
    df.write.parquet(str(tmp_path / "in"))
    assert cli.main(["profile", "--input", str(tmp_path / "in"), "--output-dir", str(tmp_path / "p"),
                     "--text-col", "text"]) == 0
    d = spark.read.json(str(tmp_path / "p/length_describe")).first()
    assert d["count"] == 4 and d["n_zero"] == 2 and d["max"] == 4.0
    assert spark.read.json(str(tmp_path / "p/score_describe")).first()["count"] == 3
    assert spark.read.json(str(tmp_path / "p/length_vs_score")).count() == 3
