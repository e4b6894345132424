"""Session construction and the shared checkpoint folder.

On a cluster the checkpoint folder is named by ``spark.checkpoint.dir`` (set by
whoever launches the job, pointing at shared storage).  We read it from the
session and only create one of our own when it is unset — which happens in
local tests.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # checkpoint files of collected DataFrames are removed by the context cleaner
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  driver_memory: str = "16g", app_name: str = "rubricon",
                  extra: dict | None = None) -> SparkSession:
    """Session for tests, bench and local runs (cluster jobs use spark-submit conf)."""
    b = (SparkSession.builder.master(master).appName(app_name)
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.driver.memory", driver_memory))
    for k, v in {**DEFAULT_CONF, **(extra or {})}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder, creating a local one only when unset."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        configured = tempfile.mkdtemp(prefix="rubricon-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


MAX_BROADCAST_ROWS = 1_000_000


def materialize_small(df):
    """Checkpoint a small derived table (contingency cells, bucket counts) once.

    Every later branch reads the checkpoint, so the work upstream of it —
    scans, joins, model scoring in ``mapInPandas`` — runs exactly once even
    when the plan uses the table several times; a reliable checkpoint also
    survives executor loss.  Returns ``(checkpointed, n_rows)``; the count reads
    the checkpoint only and is the size check behind later broadcasts.
    """
    checkpoint_dir(df.sparkSession)
    ck = df.checkpoint(eager=True)
    return ck, ck.count()


def join_keys(left, right, keys, how: str = "inner"):
    """Equi-join on ``keys`` in which null keys match each other; the left side's keys remain."""
    from functools import reduce

    names = {k: f"__r_{k}" for k in keys}
    other = right.select(*[right[f"`{c}`"].alias(names.get(c, c)) for c in right.columns])
    same = reduce(lambda a, b: a & b, [left[f"`{k}`"].eqNullSafe(other[f"`{n}`"]) for k, n in names.items()])
    return left.join(other, same, how).drop(*names.values())


def broadcast_if_small(df, n_rows: int, limit: int = MAX_BROADCAST_ROWS):
    """Broadcast hint only when the counted size is within ``limit``; otherwise a normal join."""
    from pyspark.sql import functions as F
    return F.broadcast(df) if n_rows <= limit else df


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``rubricon`` importable in Python workers (mapInPandas / mapInArrow).

    Installed deployments ship it with ``spark-submit --py-files`` or the executor
    image.  In local mode the driver may import it from a source folder the
    workers do not see, so the package is zipped once per context and added
    with ``addPyFile``, Spark's own way to distribute Python code.
    """
    import os
    import zipfile

    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED or not sc.master.startswith("local"):
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    out = os.path.join(tempfile.mkdtemp(prefix="rubricon-pyfiles-"), "rubricon.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(out)
    _SHIPPED.add(key)
