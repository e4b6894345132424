"""Stateless operators on a streaming source give the batch result."""

import numpy as np
from pyspark.sql import functions as F

from rubricon.sources.sinks import OrdinalHead
from rubricon.streaming import score_vector_stream

SF = "/root/testdata/sf0.001"


def test_stream_decode_equals_batch(spark, tmp_path):
    import shutil
    src = tmp_path / "in"
    src.mkdir()
    shutil.copy(f"{SF}/embeddings.parquet", src / "part-0.parquet")   # a stream source is a folder
    schema = spark.read.parquet(f"{SF}/embeddings.parquet").schema
    head = OrdinalHead(coef=np.eye(3, 64), intercept=np.zeros(3), score_points=[0.0, 1.0, 2.0, 3.0])
    stream = (spark.readStream.schema(schema).parquet(str(src))
                   .withColumn("vec", F.col("embedding").cast("array<double>")))
    q = (score_vector_stream(stream, head).select("vec_id", "score").writeStream
         .format("memory").queryName("scored_stream").outputMode("append")
         .option("checkpointLocation", str(tmp_path / "ck")).start())
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = {r["vec_id"]: r["score"] for r in spark.sql("SELECT * FROM scored_stream").collect()}
    batch = spark.read.parquet(f"{SF}/embeddings.parquet").withColumn(
        "vec", F.col("embedding").cast("array<double>"))
    from rubricon.streaming import score_vector_stream as s
    want = {r["vec_id"]: r["score"] for r in s(batch, head).select("vec_id", "score").collect()}
    assert got == want and len(got) == 500


def test_clean_answer_stream(spark, tmp_path):
    from rubricon.streaming import clean_answer_stream
    src = tmp_path / "ans"
    spark.createDataFrame([(1, "a"), (2, None), (3, "  ")], "BMH int, text string").write.parquet(str(src))
    schema = spark.read.parquet(str(src)).schema
    q = (clean_answer_stream(spark.readStream.schema(schema).parquet(str(src))).writeStream
         .format("memory").queryName("clean_stream").outputMode("append")
         .option("checkpointLocation", str(tmp_path / "ck")).start())
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = {r["BMH"]: r["blank"] for r in spark.sql("SELECT * FROM clean_stream").collect()}
    assert got == {"1": False, "3": True}
