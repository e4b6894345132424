"""The fit of all thresholds at once: gradients, passes, single metrics and the infer job in scan order."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rubricon import jobs
from rubricon.operators import agree, batch, fit, ordinal, pool
from rubricon.sources.sinks import from_reference_layout, load_head, to_reference_layout
from rubricon.sources.fixtures import toy_factory


def jobs_started(spark, f):
    """How many jobs ``f`` starts."""
    tracker = spark.sparkContext.statusTracker()
    before = set(tracker.getJobIdsForGroup(None))
    out = f()
    return out, len(set(tracker.getJobIdsForGroup(None)) - before)


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 6)) * [1, 5, 0.01, 1, 1, 0] + [0, 100, 0, 0, 0, 3]
    y = np.clip(np.digitize(x[:, 0] + 0.2 * (x[:, 1] - 100) + rng.normal(size=600), [-1.5, 0, 1.5]), 0, 3)
    return spark.createDataFrame([(i, r.tolist(), int(c)) for i, (r, c) in enumerate(zip(x, y))], "id long, vec array<double>, label_idx int").repartition(4)


@pytest.mark.parametrize("newton_values, few_tasks", [(2_000_000, 256), (0, 1)])
def test_every_threshold_is_at_its_minimum(spark, vectors, monkeypatch, newton_values, few_tasks):
    monkeypatch.setattr(fit, "NEWTON_VALUES", newton_values)
    monkeypatch.setattr(fit, "FEW_TASKS", few_tasks)
    head = ordinal.fit_thresholds(vectors, "vec", n_classes=5, reg_param=1e-2)
    got = {r["threshold"]: r for r in fit.gradients(vectors, head.coef, head.intercept, "vec", "label_idx", 1e-2).collect()}
    counts = {r["label_idx"]: r["count"] for r in vectors.groupBy("label_idx").count().collect()}
    assert {k: r["positives"] for k, r in got.items()} == {k: sum(n for c, n in counts.items() if c > k) for k in range(4)}
    assert all(got[k]["steepest"] < 1e-6 for k in range(3))
    assert not head.coef[3].any() and head.intercept[3] == pytest.approx(np.log(0.5 / 600.5))        # no row above class 3


def test_descent_reaches_a_quadratic_minimum():
    rng = np.random.default_rng(3)
    a = np.diag(np.geomspace(1e-2, 1.0, 30))
    best = rng.normal(size=30)
    d = fit.Descent(np.zeros(30), 1.0, 1e-9)
    for _ in range(400):
        if d.done:
            break
        x = d.at - best
        d.report(0.5 * x @ a @ x, a @ x)
    assert d.done and np.abs(d.x - best).max() < 1e-5


def test_newton_steps_reach_a_logistic_minimum():
    rng = np.random.default_rng(4)
    x = np.c_[rng.normal(size=(300, 5)) * [1, 30, 1, 1, 0.1], np.ones(300)]
    y = (x[:, 0] + rng.normal(size=300) > 1).astype(float)
    d, steps = fit.Descent(np.zeros(6), 0.25, 1e-10), 0
    while not d.done and steps < 40:
        z = x @ d.at
        p = 1 / (1 + np.exp(-z))
        reg = np.array([1e-3] * 5 + [0.0])
        d.report(float((np.logaddexp(0, z) - y * z).mean() + (reg * d.at ** 2).sum() / 2), x.T @ (p - y) / 300 + reg * d.at,
                 (x * (p * (1 - p))[:, None]).T @ x / 300 + np.diag(reg))
        steps += 1
    assert d.done and steps < 20


def test_fit_without_rows_raises(spark, vectors):
    with pytest.raises(ValueError):
        ordinal.fit_thresholds(vectors.filter("false"), "vec")
    mixed = vectors.select("vec", "label_idx").limit(5).unionByName(spark.createDataFrame([([1.0], 1)], "vec array<double>, label_idx int"))
    with pytest.raises(Exception):
        ordinal.fit_thresholds(mixed, "vec")


def test_best_head_is_kept(spark, vectors, tmp_path):
    v = vectors.withColumn("label", F.col("label_idx").cast("double")).withColumn("split", F.when(F.col("id") % 4 == 0, "test").otherwise("train"))
    head, metrics = jobs.fit_and_validate(v, [0.0, 1.0, 2.0, 3.0], "vec", output=str(tmp_path / "o"), eval_every=2, max_iter=9)
    m = {r["metric"]: r["value"] for r in metrics.collect()}
    assert m["best_accuracy"] >= m["exact_accuracy"] > 0
    best = load_head(spark, str(tmp_path / "o/best_model"))
    test = ordinal.validate(ordinal.head_logits(v.filter("split = 'test'"), best, "vec"), best.score_points)
    assert {r["metric"]: r["value"] for r in test.collect()}["exact_accuracy"] == pytest.approx(m["best_accuracy"])
    assert (load_head(spark, str(tmp_path / "o/model")).coef == head.coef).all()


def test_single_metrics_start_no_job(spark):
    df = spark.range(300).select(F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("g"), (F.col("id") % 7).cast("double").alias("pred"), (F.col("id") * 5 % 11).cast("double").alias("label"))
    whole = {(r["g"], r["metric"]): r["value"] for r in agree.compute_metrics(df, group_cols=["g"]).collect()}
    for name in agree.SUMMED:
        out, n = jobs_started(spark, lambda: agree.choose_metrics(df, [name], group_cols=["g"]))
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert n == 0 and "Window" not in plan and "rank" not in plan
        assert {r["g"]: r[name] for r in out.collect()} == pytest.approx({g: v for (g, m), v in whole.items() if m == name})
    several = agree.choose_metrics(df, ["kappa", "pearson", "mae", "qwk"], group_cols=["g"]).collect()
    assert all(r[m] == pytest.approx(whole[r["g"], m]) for r in several for m in ("kappa", "pearson", "mae", "qwk"))
    two = agree.choose_metrics(df, ["kappa", "pearson", "mae"], group_cols=["g"]).collect()
    assert all(r[m] == pytest.approx(whole[r["g"], m]) for r in two for m in ("kappa", "pearson", "mae"))
    with pytest.raises(ValueError):
        agree.choose_metrics(df, ["f1"])


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_scan_order_batches(spark, tmp_path, fmt):
    texts = [" " if i % 7 == 0 else None if i % 11 == 0 else f"t{i}" + ("@" if i in (40, 101, 333) else "") for i in range(500)]
    rows = [(f"{i:04d}", t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "BMH string, text string").coalesce(1)
    df.write.option("maxRecordsPerFile", 90).option("header", "true").format(fmt).save(str(tmp_path / "in"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        read = spark.read.format(fmt).option("header", "true").schema("BMH string, text string").load(str(tmp_path / "in"))
        scored, counts = jobs.score_table(read.withColumn("extra", F.lit(1)), toy_factory(), order="input")
        got = {r["BMH"]: r["status"] for r in scored.collect()}
        assert read.rdd.getNumPartitions() > 3
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    live = [(b, t) for b, t in rows if t is not None and t.strip()]
    want = {b: "skipped" for b, t in rows}
    for i in range(0, len(live), 16):
        part = live[i:i + 16]
        want |= {b: "failed" if any("@" in t for _, t in part) else "success" for b, _ in part}
    assert got == want
    assert {r["status"]: r["n"] for r in counts.collect()} == {s: list(want.values()).count(s) for s in set(want.values())}
    by_column, _ = jobs.score_table(read, toy_factory(), order="BMH")
    assert {r["BMH"]: r["status"] for r in by_column.collect()} == want


def test_scan_order_needs_files(spark):
    with pytest.raises(ValueError):
        jobs.score_table(spark.createDataFrame([("1", "a")], "BMH string, text string"), toy_factory(), order="input")


def test_reference_layout_and_back(spark, tmp_path):
    df = spark.createDataFrame([("1", "abc"), ("2", " "), ("3", "@")], "BMH string, text string").repartition(3)
    scored = batch.batch_score(df, toy_factory(), batch_size=1)
    back = from_reference_layout(to_reference_layout(scored))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, scored.collect()))
    out, counts = jobs.score_table(df, toy_factory(), str(tmp_path / "s"), batch_size=1, fmt="csv", reference_layout=True)
    assert {r["status"]: r["n"] for r in counts.collect()} == {"success": 1, "skipped": 1, "failed": 1}
    assert set(jobs.profile_table(out)) >= {"score_describe", "length_vs_score"}


def test_attention_states(spark, monkeypatch):
    rng = np.random.default_rng(5)
    data = [(None if s == 3 else s, p, None if p % 9 == 4 else int(rng.random() < 0.6 and s != 2), (rng.normal(size=4) * 300).tolist()) for s in range(6) for p in range(30)]
    data += [(0, 99, 1, None), (7, 0, 0, [1.0, 2.0, 3.0, 4.0])]
    t = spark.createDataFrame(data, "seq_id long, pos int, mask int, vec array<double>").repartition(5)
    q = [0.3, -1.0, 0.5, 2.0]
    want = {}
    for s in {r[0] for r in data}:
        mine = [r for r in data if r[0] == s and r[3] is not None]
        v = np.array([r[3] for r in mine])
        m = np.array([1 if r[2] is None else r[2] for r in mine])
        score = v @ q
        w = np.exp(np.where(m > 0, score - score[m > 0].max(), -np.inf)) if m.any() else np.ones(len(v))
        want[s] = w @ v / w.sum()
    for values in (pool.FOLD_VALUES, 4):
        monkeypatch.setattr(pool, "FOLD_VALUES", values)
        got = {r["seq_id"]: r["pooled"] for r in pool.pool_attention(t, q).collect()}
        assert got.keys() == want.keys() and all(np.allclose(got[s], want[s]) for s in want)
    plain = {r["seq_id"]: r["pooled"] for r in pool.pool_attention(t, q, method="explode").collect()}
    assert all(np.allclose(plain[s], want[s]) for s in want)
    last = {r["seq_id"]: r["pooled"] for r in pool.pool_last(t.filter("vec is not null")).collect()}
    assert None in last and last[7] == [1.0, 2.0, 3.0, 4.0]


def test_no_exchange_carries_a_token_vector(spark):
    t = spark.createDataFrame([(s, p, 1, [1.0, 2.0]) for s in range(5) for p in range(4)], "seq_id long, pos int, mask int, vec array<double>")
    plan = pool.pool_last(t)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan
    plan = pool.pool_attention(t, [1.0, 0.0])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("RepartitionByExpression") < plan.index("MapInArrow", plan.index("RepartitionByExpression"))


def test_heads_beyond_the_broadcast_limit(spark, monkeypatch):
    from rubricon.operators import blocks
    from rubricon.plans.catalog import rule_deep_head, rule_linear_head

    rng = np.random.default_rng(7)
    data = [(i % 50, None if i == 3 else [None] * 21 if i == 4 else rng.normal(size=21).tolist()) for i in range(60)]
    df = spark.createDataFrame(data, "id int, vec array<double>").repartition(4)
    for head in (rule_linear_head(21), rule_deep_head(21, (10, 10, 4))):
        want = sorted(repr((r["id"], None if r["logits"] is None else np.round(r["logits"], 9).tolist())) for r in ordinal.head_logits(df, head, "vec").collect())
        with monkeypatch.context() as m:
            m.setattr(ordinal, "MAX_HEAD_VALUES", 5)
            for side, panel in ((4, 7), (1000, 1000)):
                m.setattr(blocks, "SIDE", side)
                m.setattr(blocks, "PANEL", panel)
                got = ordinal.head_logits(df, head, "vec")
                assert got.columns == ["id", "vec", "logits"]
                assert sorted(repr((r["id"], None if r["logits"] is None else np.round(r["logits"], 9).tolist())) for r in got.collect()) == want
            with pytest.raises(Exception):
                ordinal.head_logits(df.limit(2).withColumn("vec", F.array(F.lit(1.0))), head, "vec").collect()
