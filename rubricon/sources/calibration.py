"""Human-score (calibration) tables.

Files may list their columns in any order.  A single glob read of CSVs maps
columns by position and silently mixes them, so files are grouped by their header
and the groups are combined with ``unionByName``.
"""

from __future__ import annotations

import csv
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rubricon.sources.answers import ANSWER_ID_COL, CALIBRATION_SCORE_COL, require_columns

# Strings pandas' CSV reader treats as missing by default.
PANDAS_NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]


def _list_files(spark: SparkSession, pattern: str) -> list[str]:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    fs = path.getFileSystem(conf)
    statuses = fs.globStatus(path)
    if statuses is None:
        return []
    return sorted(str(s.getPath().toString()) for s in statuses if s.isFile())


def union_calibration(parts: list[DataFrame], id_col: str = ANSWER_ID_COL,
                      score_col: str = CALIBRATION_SCORE_COL) -> DataFrame:
    """Concatenate calibration parts by column name, keep (BMH, label), cast, drop nulls.

    The score is cast to double *before* nulls are dropped, with ANSI casting, so a
    malformed number fails the load instead of turning into null.
    """
    if not parts:
        raise FileNotFoundError("no calibration parts given")
    for p in parts:
        require_columns(p, [id_col, score_col], "calibration table")
    slim = [p.select(F.col(id_col).cast("string").alias("BMH"),
                     F.col(score_col).alias("label")) for p in parts]
    unioned = reduce(lambda a, b: a.unionByName(b), slim)
    return (unioned.select("BMH", F.col("label").cast("double").alias("label"))
                   .na.drop("any"))


def file_headers(spark: SparkSession, files: list[str]) -> dict[str, list[str]]:
    """Column names of every CSV file, read in one job: the first line of each file, one row a file."""
    lines = spark.read.text(files).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
                                          F.monotonically_increasing_id().alias("at"))
    first = lines.filter("start = 0").groupBy("file").agg(F.min_by("value", "at").alias("value"))
    return {r["file"]: next(csv.reader([r["value"].removeprefix("\ufeff")]), []) for r in first.collect()}


def load_calibration(spark: SparkSession, pattern: str, id_col: str = ANSWER_ID_COL,
                     score_col: str = CALIBRATION_SCORE_COL,
                     na_tokens: list[str] | None = None) -> DataFrame:
    """Read every CSV matching ``pattern`` (Hadoop glob) and union them by name.

    One job reads all headers; files with the same header are read together under a schema declared from it, so the number
    of jobs does not grow with the files and the plan has one branch for each distinct header.
    Raises ``FileNotFoundError`` when nothing matches, ``ValueError`` naming the file when a column is missing.  Values listed in
    ``na_tokens`` (default: pandas' list) become null before the cast.  A file without any line has no columns.
    """
    files = _list_files(spark, pattern)
    if not files:
        raise FileNotFoundError(f"the pattern {pattern} names no calibration file")
    tokens = PANDAS_NA_TOKENS if na_tokens is None else na_tokens
    by_header: dict[tuple[str, ...], list[str]] = {}
    headers = file_headers(spark, files)
    if len(headers) < len(files):
        raise ValueError(f"{len(files) - len(headers)} of the calibration files {pattern} are empty")
    for f, header in sorted(headers.items()):
        missing = [c for c in (id_col, score_col) if c not in header]
        if missing:
            raise ValueError(f"calibration file {f} has no column {', '.join(missing)}")
        by_header.setdefault(tuple(header), []).append(f)
    parts = []
    for header, same in by_header.items():
        schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(header))])     # by position: names may repeat
        raw = spark.read.schema(schema).option("header", "true").csv(same)
        cells = {c: F.col(f"c{header.index(c)}") for c in (id_col, score_col)}
        parts.append(raw.select(*[F.when(~v.isin(tokens), v).alias(c) for c, v in cells.items()]))
    return union_calibration(parts, id_col, score_col)
