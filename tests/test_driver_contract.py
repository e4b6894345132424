"""The driver calls entry() from its own process and working directory, with a plain session."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = f"""
import sys
sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
s = (SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2")
     .config("spark.ui.enabled", "false").getOrCreate())
import __spark_entry__ as E
df = E.entry(s)
n = len(df.collect())
assert n > 0, n
assert set(E.oracle_sql()) <= set(E.queries())
print("ENTRY_OK", n)
"""


def test_entry_in_fresh_process_from_other_cwd(tmp_path):
    r = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path, capture_output=True, text=True, timeout=600)
    assert "ENTRY_OK" in r.stdout, r.stderr[-3000:]
