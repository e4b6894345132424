"""Profiles: describe, histogram, blank test and length semantics."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rubricon.functions.text import is_blank
from rubricon.operators import profile


def test_describe_golden(spark):
    df = spark.createDataFrame([(float(v),) for v in [0, 2, 3, 3, 10]], "x double")
    r = profile.describe(df, "x").first().asDict()
    want = dict(count=5, mean=3.6, std=3.781534, min=0, p25=2, p50=3, p75=3, p90=7.2, p95=8.6, p99=9.72, max=10)
    for k, v in want.items():
        assert round(r[k], 6) == pytest.approx(v, abs=1e-9), k


def test_describe_single_value_has_null_std(spark):
    r = profile.describe(spark.createDataFrame([(1.0,)], "x double"), "x").first()
    assert r["count"] == 1 and r["std"] is None and r["p99"] == 1.0


def test_describe_approx_close(spark):
    df = spark.range(1000).select(F.col("id").cast("double").alias("x"))
    a = profile.describe(df, "x").first()
    b = profile.describe(df, "x", method="approx").first()
    assert abs(a["p50"] - b["p50"]) <= 1.0 and a["mean"] == pytest.approx(b["mean"])


def test_histogram_golden(spark):
    df = spark.createDataFrame([(float(v),) for v in [0, 2, 3, 3, 10]], "x double")
    h = profile.histogram(df, "x", 5).orderBy("bin").collect()
    assert [r["n"] for r in h] == [1, 3, 0, 0, 1]
    assert [r["lo"] for r in h] + [h[-1]["hi"]] == [0, 2, 4, 6, 8, 10]


def test_histogram_constant_widens(spark):
    df = spark.createDataFrame([(3.0,)] * 3, "x double")
    h = profile.histogram(df, "x", 4).orderBy("bin").collect()
    assert [r["n"] for r in h] == [0, 0, 3, 0]
    assert h[0]["lo"] == 2.5 and h[-1]["hi"] == 3.5


def test_blank_and_length(spark):
    vals = ["", "  ", "　", " \n", "\x1c", "春天😀", None, "a"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, t string")
    got = {r["i"]: (r["b"], r["n"]) for r in
           df.select("i", is_blank("t").alias("b"), F.length("t").alias("n")).collect()}
    assert [got[i][0] for i in range(5)] == [True] * 5
    assert got[5] == (False, 3) and got[6][0] is True and got[7][0] is False
    for v in vals[:6]:
        assert (v.strip() == "") == got[vals.index(v)][0]


def test_length_profile_counts_null_as_zero(spark):
    df = spark.createDataFrame([("ab",), (None,), ("",)], "text string")
    d, h = profile.length_profile(df, "text", bins=2)
    r = d.first()
    assert r["count"] == 3 and r["n_zero"] == 2 and r["max"] == 2.0
    assert sum(x["n"] for x in h.collect()) == 3


def test_score_profile_absent_column(spark):
    assert profile.score_profile(spark.createDataFrame([("a",)], "text string")) is None


def test_describe_sorted_path_equals_window_path(spark):
    import random
    rnd = random.Random(4)
    rows = [(g, round(rnd.gauss(0, 10), 3)) for g in ("a", "b") for _ in range(500)] + [("a", 1.0)] * 50
    df = spark.createDataFrame(rows, "g string, x double")
    a = {r["g"]: r.asDict() for r in profile.describe(df, "x", ["g"]).collect()}
    b = {r["g"]: r.asDict() for r in profile.describe(df, "x", ["g"], max_window_rows=0).collect()}
    for g in a:
        for k, v in a[g].items():
            if isinstance(v, float):
                assert b[g][k] == pytest.approx(v, rel=1e-12, abs=1e-12), (g, k)
            else:
                assert b[g][k] == v
    import numpy as np
    xs = np.array([x for gg, x in rows if gg == "a"])
    for p, name in [(0.25, "p25"), (0.5, "p50"), (0.99, "p99")]:
        assert a["a"][name] == pytest.approx(float(np.quantile(xs, p)), abs=1e-9)


@pytest.mark.parametrize("values,bins", [(list(range(89)), 80), (list(range(561)), 80), ([0.1 * i for i in range(31)], 7)])
def test_histogram_edges_are_numpys(spark, values, bins):
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    want, edges = np.histogram(np.array(values, dtype=float), bins)
    got = profile.histogram(df, "x", bins).orderBy("bin").collect()
    assert [r["n"] for r in got] == want.tolist()
    assert [r["lo"] for r in got] + [got[-1]["hi"]] == edges.tolist()
