"""Golden agreement metrics (FIXTURES §3) and properties of the contingency design."""

import math
import random

import pytest

from rubricon.operators import agree

SETS = {
    "A": ([0, 2, 4, 4, 1], [0, 2, 3, 4, 1], 1.0,
          dict(exact_accuracy=0.8, mae=0.2, rmse=0.447214, qwk=0.956522, kappa=0.75,
               pearson=0.972272, spearman=0.974679, acc_05=0.8, tol_acc=1.0, tol_qwk=1.0)),
    "B": ([0, 1.5, 4, 2.5, 1, 3, 0.5, 3.5], [0, 2, 3, 2.5, 1, 1.5, 0.5, 4], 0.5,
          dict(exact_accuracy=0.5, mae=0.4375, rmse=0.684653, qwk=0.864865, kappa=0.438596,
               pearson=0.877454, spearman=0.904762, acc_05=0.75, tol_acc=0.75, tol_qwk=0.895833)),
    "gap": ([0, 10, 10, 40], [0, 10, 40, 40], 1.0,
            dict(exact_accuracy=0.75, mae=7.5, rmse=15.0, qwk=0.8, kappa=0.636364,
                 pearson=0.70014, spearman=0.833333, acc_05=0.75, tol_acc=0.75, tol_qwk=0.8)),
}


def _df(spark, preds, labels, group=None):
    rows = [(group, float(p), float(l)) for p, l in zip(preds, labels)]
    return spark.createDataFrame(rows, "g string, pred double, label double")


@pytest.mark.parametrize("name", list(SETS))
def test_golden_metrics(spark, name):
    preds, labels, tol, exp = SETS[name]
    got = {r["metric"]: r["value"] for r in
           agree.compute_metrics(_df(spark, preds, labels), tolerance=tol).collect()}
    key = {"acc_05": "acc_0.5", "tol_acc": f"tolerance_acc({tol})", "tol_qwk": f"tolerance_qwk({tol})"}
    for k, v in exp.items():
        assert round(got[key.get(k, k)], 6) == pytest.approx(v, abs=1e-6), k


def test_tolerance_off_has_no_tolerance_metrics(spark):
    preds, labels, _, _ = SETS["A"]
    names = [r["metric"] for r in agree.compute_metrics(_df(spark, preds, labels)).collect()]
    assert names == ["exact_accuracy", "mae", "rmse", "qwk", "kappa", "pearson", "spearman", "acc_0.5"]


def test_tolerance_zero_is_computed(spark):
    preds, labels, _, _ = SETS["A"]
    names = [r["metric"] for r in agree.compute_metrics(_df(spark, preds, labels), tolerance=0.0).collect()]
    assert "tolerance_acc(0.0)" in names


def test_constant_columns_give_null_not_error(spark):
    got = {r["metric"]: r["value"] for r in
           agree.compute_metrics(_df(spark, [1, 1, 1], [1, 1, 1])).collect()}
    assert got["exact_accuracy"] == 1.0
    assert got["pearson"] is None and got["spearman"] is None
    assert got["qwk"] is None and got["kappa"] is None


def test_grouped_equals_union_of_single_groups(spark):
    rows = []
    for g, (preds, labels, _, _) in SETS.items():
        rows += [(g, float(p), float(l)) for p, l in zip(preds, labels)]
    df = spark.createDataFrame(rows, "g string, pred double, label double")
    grouped = {(r["g"], r["metric"]): r["value"] for r in
               agree.compute_metrics(df, group_cols=["g"]).collect()}
    for g, (preds, labels, _, _) in SETS.items():
        single = {r["metric"]: r["value"] for r in agree.compute_metrics(_df(spark, preds, labels)).collect()}
        for m, v in single.items():
            assert grouped[(g, m)] == pytest.approx(v, abs=1e-12)


def _qwk_matrix(preds, labels):
    vals = sorted(set(preds) | set(labels))
    ix = {v: i for i, v in enumerate(vals)}
    k = len(vals)
    o = [[0.0] * k for _ in range(k)]
    for p, l in zip(preds, labels):
        o[ix[l]][ix[p]] += 1
    n = len(preds)
    rs = [sum(r) for r in o]
    cs = [sum(o[i][j] for i in range(k)) for j in range(k)]
    num = sum((i - j) ** 2 * o[i][j] for i in range(k) for j in range(k))
    den = sum((i - j) ** 2 * rs[i] * cs[j] / n for i in range(k) for j in range(k))
    return 1 - num / den


def test_qwk_moment_form_equals_matrix_form(spark):
    rnd = random.Random(7)
    preds = [rnd.choice([0, 0.5, 1, 2, 3.5, 4]) for _ in range(400)]
    labels = [rnd.choice([0, 1, 1.5, 2, 4]) for _ in range(400)]
    got = agree.qwk(_df(spark, preds, labels)).first()["qwk"]
    assert got == pytest.approx(_qwk_matrix(preds, labels), abs=1e-12)


def test_tolerance_curve(spark):
    preds, labels, _, _ = SETS["gap"]
    rows = {(r["op"], r["threshold"]): r["share"] for r in
            agree.tolerance_curve(_df(spark, preds, labels)).collect()}
    assert rows[("le", 0.0)] == 0.75 and rows[("gt", 7.0)] == 0.25 and rows[("gt", 10.0)] == 0.25
    assert len(rows) == 16


def test_large_value_table_path_matches(spark, monkeypatch):
    """Continuous predictions: value-table ranks from range-partitioned sorts equal the window path."""
    from rubricon.operators import prepare
    rows = []
    for g, (preds, labels, _, _) in SETS.items():
        rows += [(g, float(p), float(l)) for p, l in zip(preds, labels)]
    df = spark.createDataFrame(rows, "g string, pred double, label double")
    want = {(r["g"], r["metric"]): r["value"] for r in agree.compute_metrics(df, group_cols=["g"], tolerance=1.0).collect()}
    monkeypatch.setattr(prepare, "MAX_WINDOW_ROWS", 0)
    got = {(r["g"], r["metric"]): r["value"] for r in agree.compute_metrics(df, group_cols=["g"], tolerance=1.0).collect()}
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] == pytest.approx(v, abs=1e-12), k


def test_single_metric_functions(spark):
    preds, labels, _, exp = SETS["A"]
    df = _df(spark, preds, labels)
    assert agree.exact_accuracy(df).first()[0] == pytest.approx(exp["exact_accuracy"])
    assert agree.mae(df).first()[0] == pytest.approx(exp["mae"])
    assert round(agree.rmse(df).first()[0], 6) == exp["rmse"]
    assert round(agree.qwk(df).first()[0], 6) == exp["qwk"]
    assert round(agree.kappa(df).first()[0], 6) == exp["kappa"]
    assert round(agree.pearson(df).first()[0], 6) == exp["pearson"]
    assert round(agree.spearman(df).first()[0], 6) == exp["spearman"]
    assert agree.acc_within(df, 0.5).first()[0] == exp["acc_05"]
    assert round(agree.tolerance_qwk(df, 1.0).first()[0], 6) == exp["tol_qwk"]


def test_pair_by_key(spark):
    p = spark.createDataFrame([("1", "x", 1.0), ("2", "y", 2.0), ("3", "x", 0.0)], "id string, g string, pred double")
    l = spark.createDataFrame([("1", 1.0), ("2", 3.0)], "id string, label double")
    got = sorted(tuple(r) for r in agree.pair(p, l, "id", keep=["g"]).collect())
    assert got == [("1", "x", 1.0, 1.0), ("2", "y", 2.0, 3.0)]
