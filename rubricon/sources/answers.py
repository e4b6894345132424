"""Answer tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Column names of the reference's input files.
ANSWER_ID_COL = "BMH"
ANSWER_TEXT_COL = "OCR文字结果"
CALIBRATION_SCORE_COL = "ZZCJ"


def require_columns(df: DataFrame, columns: Iterable[str], what: str = "input") -> DataFrame:
    """Fail before any job starts when a required column is missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what} is missing required column(s) {missing}; has {df.columns}")
    return df


def read_table(spark: SparkSession, path: str, fmt: str = "parquet",
               schema=None, **options) -> DataFrame:
    """Read one table.  CSV keeps every value as a string unless a schema is given
    (keys keep their leading zeros); ``partition_filter`` style selection by
    subject/question is a plain ``filter`` on a partitioned layout (A4)."""
    reader = spark.read.format(fmt)
    if fmt == "csv":
        # texts hold line breaks and quotes
        reader = reader.option("header", "true").option("multiLine", "true").option("escape", '"')
    if schema is not None:
        reader = reader.schema(schema)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load(path)


def load_answers(df: DataFrame, id_col: str = ANSWER_ID_COL, text_col: str = ANSWER_TEXT_COL,
                 keep: Iterable[str] = (), na_tokens: Iterable[str] | None = None) -> DataFrame:
    """Answer table ``(BMH string, text string)``: project, rename, drop null text.

    Only *null* text is dropped here; blank text is kept (training semantics).
    ``keep`` carries extra columns such as group keys (subject, question).
    ``na_tokens`` reproduces spreadsheet/CSV readers that turn strings such as
    ``"None"`` or ``"NA"`` into missing values (pass ``PANDAS_NA_TOKENS``); by
    default text is kept as stored, since Parquet has real nulls.
    """
    require_columns(df, [id_col, text_col, *keep], "answer table")
    text = F.col(text_col).cast("string")
    if na_tokens is not None:
        text = F.when(text.isin(list(na_tokens)), F.lit(None).cast("string")).otherwise(text)
    return (df.select(F.col(id_col).cast("string").alias("BMH"), text.alias("text"), *keep)
              .filter(F.col("text").isNotNull()))


def read_question(spark: SparkSession, path: str, subject_id: str | None = None,
                  question_id: str | None = None, fmt: str = "parquet") -> DataFrame:
    """Read one (subject, question) from a ``subject_id=/question_id=`` partitioned layout (A4).

    The choice is a filter on partition columns, so the scan only lists the
    matching folders (partition pruning) instead of opening every file.
    """
    df = spark.read.format(fmt).option("basePath", path).load(path)
    if subject_id is not None:
        df = df.filter(F.col("subject_id") == str(subject_id))
    if question_id is not None:
        df = df.filter(F.col("question_id") == str(question_id))
    return df


def write_by_question(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Write a table partitioned by ``subject_id`` and ``question_id``."""
    df.write.mode(mode).format(fmt).partitionBy("subject_id", "question_id").save(path)
