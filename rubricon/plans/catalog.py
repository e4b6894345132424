"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per key.

Each query reads the driver's tables through the fixture builders and runs the
library operators over the whole tables.  Floating outputs are rounded to 6
digits so the DuckDB oracle in :mod:`rubricon.plans.oracle` can match them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rubricon import jobs
from rubricon.operators import agree, batch, fit, ordinal, pool, prepare, profile, track
from rubricon.session import checkpoint_dir
from rubricon.sources.sinks import REFERENCE_SCORE_COL, REFERENCE_STATUS_COL, OrdinalHead, load_head, save_head
from rubricon.sources import fixtures as fx
from rubricon.sources.answers import load_answers, read_question, require_columns, write_by_question
from rubricon.sources.calibration import load_calibration, union_calibration

ROUND = 6
SEED = 42
TEST_SIZE = 0.2
PAD_LEN = 32
BATCH_SIZE = 16
EPOCHS = 2
RATE_TOLERANCE = 2.0
VALIDATE_TOLERANCE = 1.0
SCORE_BATCH = 16
LOG_EVERY = 10
FIT_REG = 1e-3
POSITION_CHUNK = 5_000
DEEP_SIZES = (16, 8)


def _r(c, digits: int = ROUND):
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


# ---------------------------------------------------------------- prepare

def answers(spark, sf):
    return load_answers(fx.stored_answers(spark, sf), text_col="text", keep=["lang"])


def calibration(spark, sf):
    return union_calibration(fx.calibration_parts(spark, sf))


def q_answers_clean(spark: SparkSession, sf: str) -> DataFrame:
    return load_answers(fx.raw_answers(spark, sf), text_col="text").select("BMH", "text")


def q_calibration_union(spark, sf):
    return calibration(spark, sf)


def labelled(spark, sf, group_cols=("lang",)):
    joined = prepare.join_labels(answers(spark, sf), calibration(spark, sf))
    out, _ = prepare.encode_ordinal(joined, "label", list(group_cols))
    return out


def q_labelled_join(spark, sf):
    return labelled(spark, sf).select("lang", "BMH", "text", "label", "label_idx")


def q_score_points(spark, sf):
    pts = prepare.score_points(calibration(spark, sf))
    return prepare.score_points_preview(pts).select("label_idx", "label", "K", "preview")


def _split(spark, sf):
    out, _ = prepare.prepare_labelled(answers(spark, sf), calibration(spark, sf), TEST_SIZE, SEED)
    return out


def q_split_members(spark, sf):
    return _split(spark, sf).select("BMH", "label", "label_idx", "split")


def q_split_counts(spark, sf):
    return prepare.split_counts(_split(spark, sf))


def q_split_hash(spark, sf):
    return prepare.split_hash(answers(spark, sf), ["BMH"], TEST_SIZE, SEED).select("BMH", "split")


def q_pad_truncate(spark, sf):
    a = answers(spark, sf).withColumn("tokens", prepare.word_lengths("text"))
    padded = prepare.pad_truncate(a, "tokens", PAD_LEN, pad_id=0)
    return padded.select("BMH", F.posexplode(F.arrays_zip("input_ids", "attention_mask"))) \
                 .select("BMH", F.col("pos").cast("int").alias("pos"),
                         F.col("col.input_ids").cast("int").alias("input_id"),
                         F.col("col.attention_mask").cast("int").alias("mask"))


def q_pad_batches(spark, sf):
    """Padding to the longest row of a batch of 16 documents; every 50th document has no batch."""
    doc = F.col("BMH").cast("long")
    a = answers(spark, sf).withColumn("tokens", prepare.word_lengths("text")).withColumn(
        "batch", F.when(doc % 50 != 0, F.floor(doc / BATCH_SIZE)))
    padded = prepare.pad_truncate(a.select("BMH", "batch", "tokens"), "tokens", PAD_LEN, pad_id=0, batch_col="batch")
    return padded.select("BMH", F.size("input_ids").cast("long").alias("width"), *_sums())


def _sums():
    add = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, v: s + v)
    return add("input_ids").alias("id_sum"), add("attention_mask").alias("n_real")


def q_training_examples(spark, sf):
    tokens = labelled(spark, sf, ()).withColumn("tokens", prepare.word_lengths("text"))
    e = prepare.encode_examples(tokens, "tokens", PAD_LEN, side="left")
    return e.select("BMH", "label", "label_idx", F.size("input_ids").cast("long").alias("width"), *_sums())


def _marked_lines(spark, sf):
    """Line items by return flag, the largest flag as the null group."""
    li = fx.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_returnflag")
    return li.select(F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("flag"),
                     (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("line"), F.col("l_extendedprice").cast("double").alias("price"))


def q_ranked_null_groups(spark, sf):
    """Shuffle ranks in groups of which one is null; buckets above two rows take the sorted path."""
    r = prepare.global_rank(_marked_lines(spark, sf).select("flag", "line"), ["line"], SEED, partition_cols=["flag"], max_window_rows=2)
    return r.select("flag", "line", "rank")


def q_positions(spark, sf):
    """Positions in sequences of which the null one holds half of the rows, in chunks cut at sketched quantiles."""
    return pool.with_positions(_marked_lines(spark, sf).select("flag", "line"), "flag", "line", most_rows=POSITION_CHUNK)


def q_calibration_files(spark, sf):
    """The calibration parts as CSV files with their columns in different orders, read back by one pattern."""
    folder = _folder(spark, "calibration")
    for i, part in enumerate(fx.calibration_parts(spark, sf)):
        part.withColumn(f"note{i}", F.lit("x, \"y\"")).repartition(3).write.option("header", "true").csv(f"{folder}/{i}")
    return load_calibration(spark, f"{folder}/*/*.csv")


def _folder(spark, name):
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def q_shuffled_batches(spark, sf):
    b = prepare.shuffled_batches(answers(spark, sf).select("BMH"), ["BMH"], BATCH_SIZE, EPOCHS, SEED)
    return b.select("epoch", "BMH", "batch_id", "batch_pos")


# ---------------------------------------------------------------- agree

def q_contingency(spark, sf):
    return agree.contingency(fx.ratings(spark, sf), group_cols=["l_returnflag"])


def q_agreement_metrics(spark, sf):
    m = agree.compute_metrics(fx.ratings(spark, sf), group_cols=["l_returnflag"])
    return m.select("l_returnflag", "metric", _r("value").alias("value"))


def q_summed_metrics(spark, sf):
    """The metrics that need no order of values, asked for by name."""
    wide = agree.choose_metrics(fx.ratings(spark, sf), agree.SUMMED, group_cols=["l_returnflag"])
    return agree.to_long(wide, ["l_returnflag"], agree.SUMMED).select("l_returnflag", "metric", _r("value").alias("value"))


def q_tolerance_curve(spark, sf):
    c = agree.tolerance_curve(fx.ratings(spark, sf))
    return c.select("op", "threshold", _r("share").alias("share"))


def q_tolerance_qwk(spark, sf):
    q = agree.tolerance_qwk(fx.ratings(spark, sf), RATE_TOLERANCE, group_cols=["l_returnflag"])
    return q.select("l_returnflag", _r("tolerance_qwk").alias("tolerance_qwk"))


# ---------------------------------------------------------------- ordinal

def rule_linear_head(dim: int = 65, thresholds: int = fx.PROB_THRESHOLDS) -> OrdinalHead:
    """Fixed weights by rule: W[k][d] = ((7k + 3d) mod 11 - 5) / 10, b[k] = (k - 4) / 4."""
    coef = np.array([[float((7 * k + 3 * d) % 11 - 5) / 10.0 for d in range(dim)] for k in range(thresholds)])
    intercept = np.array([float(k - 4) / 4.0 for k in range(thresholds)])
    return OrdinalHead(coef=coef, intercept=intercept, score_points=fx.prob_score_points())


def rule_deep_head(dim: int = 64, sizes=DEEP_SIZES, thresholds: int = fx.PROB_THRESHOLDS) -> OrdinalHead:
    """Residual MLP head with rule weights (identity LayerNorm affine)."""
    blocks, a = [], dim
    for i, h in enumerate(sizes):
        w = np.array([[float((r * 5 + c * 3 + i) % 7 - 3) / 20.0 for c in range(a)] for r in range(h)])
        b = np.array([float(r % 3 - 1) / 10.0 for r in range(h)])
        pw = np.array([[float((r + 2 * c) % 5 - 2) / 10.0 for c in range(a)] for r in range(h)]) if a != h else None
        pb = np.zeros(h) if a != h else None
        blocks.append((np.ones(a), np.zeros(a), w, b, pw, pb))
        a = h
    coef = np.array([[float((k + 2 * c) % 5 - 2) / 4.0 for c in range(a)] for k in range(thresholds)])
    intercept = np.array([float(k - 4) / 8.0 for k in range(thresholds)])
    return OrdinalHead(coef=coef, intercept=intercept, score_points=fx.prob_score_points(), blocks=blocks)


def _vectors(spark, sf):
    e = fx.table(spark, sf, "embeddings")
    return e.select("vec_id", F.col("embedding").cast("array<double>").alias("vec"),
                    F.col("label").cast("int").alias("label_idx"),
                    F.array((F.col("vec_id") % 5).cast("double")).alias("feat"))


def _long_logits(df, key="vec_id", col="logits"):
    return df.select(key, F.posexplode(col).alias("k", "logit")).select(
        key, F.col("k").cast("int").alias("k"), _r("logit").alias("logit"))


def q_ordinal_decode(spark, sf):
    p = ordinal.decode(fx.ordinal_probs(spark, sf), fx.prob_score_points(), probs="probs")
    return p.select("vec_id", "label", "score")


def q_ordinal_loss(spark, sf):
    l = ordinal.ordinal_loss(fx.ordinal_probs(spark, sf), "logits", "label_idx")
    return l.select(_r("loss").alias("loss"), F.col("n_rows").cast("long").alias("n_rows"), "n_terms")


def q_linear_head(spark, sf):
    v = ordinal.linear_head(_vectors(spark, sf), rule_linear_head(), vec="vec", features="feat")
    return _long_logits(v)


def q_saved_head(spark, sf):
    """The linear head written as tables, read back and applied."""
    folder = _folder(spark, "head")
    save_head(spark, rule_linear_head(), folder)
    return _long_logits(ordinal.linear_head(_vectors(spark, sf), load_head(spark, folder), vec="vec", features="feat"))


def q_score_sequences(spark, sf):
    """Token vectors to pooled vectors, logits and scores."""
    s = jobs.score_sequences(fx.token_vectors(spark, sf), rule_linear_head(64), strategy="mean")
    return s.select("seq_id", "score", F.posexplode("logits").alias("k", "logit")).select(
        "seq_id", "score", F.col("k").cast("int").alias("k"), _r("logit").alias("logit"))


def q_fit_chain(spark, sf):
    """Split, fit with evaluations, save, load: what must hold, as ``(item, value)``."""
    v = prepare.split_exact(_vectors(spark, sf).withColumn("label", F.col("label_idx").cast("double")), ["vec_id"], TEST_SIZE, SEED)
    folder = _folder(spark, "fit")
    head, metrics = jobs.fit_and_validate(v, fx.prob_score_points(), vec="vec", reg_param=FIT_REG, output=folder, eval_every=5)
    loaded, best = load_head(spark, f"{folder}/model"), load_head(spark, f"{folder}/best_model")
    test = v.filter("split = 'test'")
    again = {name: {r["metric"]: r["value"] for r in ordinal.validate(ordinal.head_logits(test, h, "vec"), h.score_points).collect()}
             for name, h in (("final", loaded), ("best", best))}
    said = {r["metric"]: r["value"] for r in spark.read.json(f"{folder}/metrics").collect()}
    slope = fit.gradients(v.filter("split = 'train'"), loaded.coef, loaded.intercept, "vec", "label_idx", FIT_REG).agg(F.max("steepest")).first()[0]
    sizes = v.groupBy().agg(F.count_if(F.col("split") == "train").cast("double").alias("train_rows"), F.count_if(F.col("split") == "test").cast("double").alias("test_rows"))
    facts = {"steepest": round(slope, ROUND), "weights_changed_by_saving": float(np.abs(head.coef - loaded.coef).max()),
             "metrics_changed_by_saving": round(max(abs(said[m] - x) for m, x in again["final"].items()), ROUND),
             "best_head_misses_best_accuracy": round(said["best_accuracy"] - again["best"]["exact_accuracy"], ROUND),
             "best_below_final": max(0.0, said["exact_accuracy"] - said["best_accuracy"])}
    rows = sizes.select("*", *[F.lit(x).cast("double").alias(n) for n, x in facts.items()])
    return agree.to_long(rows, [], ["train_rows", "test_rows", *facts], metric_col="item")


def q_deep_head(spark, sf):
    v = ordinal.deep_head(_vectors(spark, sf), rule_deep_head(), vec="vec")
    return _long_logits(v)


def q_fit_thresholds(spark, sf):
    """Positives of every threshold and the steepest slope that the fit leaves (zero at the minimum)."""
    v = _vectors(spark, sf)
    head = ordinal.fit_thresholds(v, vec="vec", n_classes=fx.PROB_THRESHOLDS + 1, reg_param=FIT_REG)
    g = fit.gradients(v, head.coef, head.intercept, "vec", "label_idx", FIT_REG)
    return g.select("threshold", "positives", "n_rows", _r("steepest").alias("steepest"))


def q_validate_summary(spark, sf):
    v = ordinal.validate(fx.ordinal_probs(spark, sf), fx.prob_score_points(), tolerance=VALIDATE_TOLERANCE)
    return v.select("metric", _r("value").alias("value"))


# ---------------------------------------------------------------- pool

def _pooled_long(df):
    return pool.explode_vector(df, ["seq_id"]).select("seq_id", "dim", _r("value").alias("value"))


def q_pool_mean(spark, sf):
    return _pooled_long(pool.pool_mean(fx.token_vectors(spark, sf)))


def q_pool_unmasked(spark, sf):
    """Mean pooling of token vectors that come without a mask."""
    return _pooled_long(pool.pool(fx.token_vectors(spark, sf).drop("mask"), "mean", mask=None))


def q_pool_last(spark, sf):
    return _pooled_long(pool.pool_last(fx.token_vectors(spark, sf)))


def q_pool_attention(spark, sf):
    return _pooled_long(pool.pool_attention(fx.token_vectors(spark, sf), fx.attention_query(64)))


# ---------------------------------------------------------------- batch scoring

def scored(spark, sf):
    # input order = document id; batches are consecutive non-blank rows, as in the reference
    raw = fx.raw_answers(spark, sf).withColumn("row_id", F.col("BMH").cast("long"))
    batched = batch.input_order_batches(raw, ["row_id"], "text", SCORE_BATCH)
    out = batch.batch_score(batched, fx.toy_factory(fx.TOY_MARKER), "text", SCORE_BATCH,
                            batch_col="batch", order_cols=["row_id"])
    return out.drop("batch", "row_id")


def q_batch_score(spark, sf):
    return scored(spark, sf).select("BMH", "text", "lang", "pred_score", "status", "error")


def q_score_table(spark, sf):
    """The infer job over the file as it lies: batches in scan order, written in the reference's layout and read back."""
    out, _ = jobs.score_table(fx.raw_answers(spark, sf), fx.toy_factory(fx.TOY_MARKER), _folder(spark, "scored"), batch_size=SCORE_BATCH,
                              order="input", reference_layout=True)
    return out.select("BMH", "text", "lang", F.col(REFERENCE_SCORE_COL).alias("score"), F.col(REFERENCE_STATUS_COL).alias("status"))


def q_profile_job(spark, sf):
    """The profile job over the infer job's own file: scores under the reference's column name."""
    out, _ = jobs.score_table(fx.raw_answers(spark, sf), fx.toy_factory(fx.TOY_MARKER), _folder(spark, "scored"), batch_size=SCORE_BATCH,
                              order="input", reference_layout=True)
    return _round_cols(jobs.profile_table(out)["score_describe"], DESCRIBE_DOUBLES)


def q_question_files(spark, sf):
    """Answers written by subject and question; one question read back."""
    folder = _folder(spark, "questions")
    d = fx.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("BMH"), "text", F.col("lang").alias("subject_id"), F.col("source").alias("question_id"))
    write_by_question(d, folder)
    one = d.agg(F.min("question_id")).first()[0]
    return require_columns(read_question(spark, folder, "en", one), ["BMH", "text"]).select("BMH", "text")


def q_status_counts(spark, sf):
    return batch.status_counts(scored(spark, sf))


# ---------------------------------------------------------------- profile

def _round_cols(df, cols):
    return df.select(*[_r(c).alias(c) if c in cols else F.col(c) for c in df.columns])


DESCRIBE_DOUBLES = ["mean", "std", "min", "p25", "p50", "p75", "p90", "p95", "p99", "max"]


def q_length_describe(spark, sf):
    d, _ = profile.length_profile(fx.stored_answers(spark, sf), "text")
    return _round_cols(d, DESCRIBE_DOUBLES)


def q_describe_values(spark, sf):
    """Prices made unique, so that there are as many values as rows; the null group has half of them."""
    d = profile.describe(_marked_lines(spark, sf).withColumn("x", F.col("price") + F.col("line") / 1e9), "x", ["flag"], accuracy=200)
    return _round_cols(d, DESCRIBE_DOUBLES)


def q_length_hist(spark, sf):
    lens = profile.with_length(fx.stored_answers(spark, sf), "text")
    return _round_cols(profile.histogram(lens, "length", profile.LENGTH_BINS), ["lo", "hi"])


def q_score_profile(spark, sf):
    d, _ = profile.score_profile(fx.ratings(spark, sf), "pred")
    return _round_cols(d, DESCRIBE_DOUBLES)


def q_score_hist(spark, sf):
    scores = fx.ratings(spark, sf).filter(F.col("pred").isNotNull())
    return _round_cols(profile.nonempty_bins(profile.histogram(scores, "pred", profile.SCORE_BINS)), ["lo", "hi"])


def q_length_vs_score(spark, sf):
    j = fx.stored_answers(spark, sf).join(calibration(spark, sf), "BMH", "left")
    return profile.length_vs_score(j, "text", "label", keys=["BMH"])


def q_length_score_bins(spark, sf):
    return profile.length_score_bins(q_length_vs_score(spark, sf))


# ---------------------------------------------------------------- track

def q_improvement_events(spark, sf):
    e = track.improvement_events(fx.eval_log(spark, sf))
    return e.select("run", "step", "metric", "prev_best")


def q_best_checkpoint(spark, sf):
    return track.best_checkpoint(fx.eval_log(spark, sf)).select("run", "step", "metric")


def q_epoch_loss(spark, sf):
    e = track.epoch_loss(fx.eval_log(spark, sf))
    return e.select("run", "epoch", "n_steps", _r("train_loss").alias("train_loss"),
                    _r("weighted_loss").alias("weighted_loss"))


def q_logged_steps(spark, sf):
    return track.logged_steps(fx.eval_log(spark, sf), LOG_EVERY).select("run", "step", "metric")


# ---------------------------------------------------------------- flagship

def q_flagship_agreement(spark, sf):
    j = agree.pair(scored(spark, sf), calibration(spark, sf), "BMH", "pred_score", "label", keep=["lang"])
    m = agree.compute_metrics(j, "pred_score", "label", group_cols=["lang"])
    return m.select("lang", "metric", _r("value").alias("value"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "answers_clean": q_answers_clean,
    "calibration_union": q_calibration_union,
    "labelled_join": q_labelled_join,
    "score_points": q_score_points,
    "split_counts": q_split_counts,
    "split_members": q_split_members,
    "split_hash": q_split_hash,
    "pad_truncate": q_pad_truncate,
    "shuffled_batches": q_shuffled_batches,
    "contingency": q_contingency,
    "agreement_metrics": q_agreement_metrics,
    "tolerance_curve": q_tolerance_curve,
    "tolerance_qwk": q_tolerance_qwk,
    "ordinal_decode": q_ordinal_decode,
    "ordinal_loss": q_ordinal_loss,
    "linear_head": q_linear_head,
    "deep_head": q_deep_head,
    "fit_thresholds": q_fit_thresholds,
    "validate_summary": q_validate_summary,
    "pool_mean": q_pool_mean,
    "pool_last": q_pool_last,
    "pool_attention": q_pool_attention,
    "batch_score": q_batch_score,
    "status_counts": q_status_counts,
    "length_describe": q_length_describe,
    "length_hist": q_length_hist,
    "score_profile": q_score_profile,
    "score_hist": q_score_hist,
    "length_vs_score": q_length_vs_score,
    "length_score_bins": q_length_score_bins,
    "improvement_events": q_improvement_events,
    "best_checkpoint": q_best_checkpoint,
    "epoch_loss": q_epoch_loss,
    "logged_steps": q_logged_steps,
    "flagship_agreement": q_flagship_agreement,
    "pad_batches": q_pad_batches,
    "training_examples": q_training_examples,
    "ranked_null_groups": q_ranked_null_groups,
    "positions": q_positions,
    "calibration_files": q_calibration_files,
    "summed_metrics": q_summed_metrics,
    "saved_head": q_saved_head,
    "score_sequences": q_score_sequences,
    "fit_chain": q_fit_chain,
    "score_table": q_score_table,
    "profile_job": q_profile_job,
    "question_files": q_question_files,
    "pool_unmasked": q_pool_unmasked,
    "describe_values": q_describe_values,
}


def flagship(spark, sf):
    return q_flagship_agreement(spark, sf)
