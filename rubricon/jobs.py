"""End-to-end jobs (M4-M6, I7): the library's counterparts of the reference's
train, infer and profile programs, as functions over DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rubricon.operators import agree, batch, ordinal, pool, profile
from rubricon.session import checkpoint_dir, materialize_small
from rubricon.sources.answers import read_table, require_columns
from rubricon.sources.sinks import (
    REFERENCE_SCORE_COL, OrdinalHead, from_reference_layout, save_head, to_reference_layout, write_metrics_json, write_scored,
)


def score_sequences(tokens: DataFrame, head: OrdinalHead, strategy: str = "mean",
                    query: Sequence[float] | None = None, features: DataFrame | None = None,
                    seq: str = "seq_id", feature_col: str = "features") -> DataFrame:
    """Scorer pipeline (I7): pool token vectors -> optional feature concat -> head -> decode.

    Output ``(seq, pooled, logits, probs, score)``; ``features`` is a table
    ``(seq, features array<double>)`` joined by key (H9).
    """
    pooled = pool.pool(tokens, strategy, query=query, seq=seq)
    feat = None
    if features is not None:
        pooled = pooled.join(features.select(seq, feature_col), seq, "inner")
        feat = feature_col
    logits = ordinal.head_logits(pooled, head, "pooled", feat)
    return ordinal.decode(ordinal.probabilities(logits), head.score_points)


def ordinal_text_scorer(embed_factory: Callable[[], Callable[[list[str]], "np.ndarray"]],
                        head: OrdinalHead, spark=None) -> Callable[[], Callable[[list[str]], list[float]]]:
    """Scorer factory for :func:`rubricon.operators.batch.batch_score`.

    ``embed_factory()`` builds the user's backbone once per Python worker: a
    callable mapping a list of texts to a (batch, D) array of pooled vectors.
    The returned scorer applies the ordinal head, the sigmoid and the decode to
    score points in numpy, so one exception from the backbone fails the batch,
    as in the reference.  With ``spark`` the head (size-checked) ships once per
    executor as a broadcast variable instead of inside every task's closure.
    """
    import numpy as np

    from rubricon.operators.ordinal import _check_size, decode_numpy, head_forward

    _check_size(head)
    shipped = spark.sparkContext.broadcast(head) if spark is not None else None

    def make():
        embed = embed_factory()
        h = shipped.value if shipped is not None else head

        def score(texts: list[str]) -> list[float]:
            vecs = np.asarray(embed(texts), dtype=float)
            probs = 1.0 / (1.0 + np.exp(-head_forward(vecs, h)))
            return decode_numpy(probs, h.score_points).tolist()
        return score
    return make


def fit_and_validate(vectors: DataFrame, score_points: Sequence[float], vec: str = "pooled",
                     tolerance: float = 0.0, reg_param: float = 1e-3, max_iter: int = 100,
                     output: str | None = None, eval_every: int | None = None) -> tuple[OrdinalHead, DataFrame]:
    """Train job (M4) on frozen vectors with a ``split`` column from ``split_exact``.

    Fits the thresholds on ``split = 'train'`` and validates on ``split = 'test'``
    (D14; tolerance only when > 0): after every ``eval_every`` passes of the fit, if given, and at the end.  The head with the
    highest exact accuracy above 0 so far is the best one, the earliest on ties; ``best_accuracy`` among the metrics is its accuracy (0 if there is none).
    With ``output``, writes the final head to ``model``, the best one to ``best_model`` (A9) and the final metrics as JSON (A7).
    The test rows are checkpointed once if they are validated more than once.
    """
    require_columns(vectors, [vec, "label", "label_idx", "split"], "vector table")
    train = vectors.filter(F.col("split") == "train")
    test = vectors.filter(F.col("split") == "test")
    if eval_every:
        checkpoint_dir(vectors.sparkSession)
        test = test.select(vec, "label", "label_idx").checkpoint(eager=True)
    best: list = [0.0, None]

    def evaluated(head: OrdinalHead) -> DataFrame:
        metrics, _ = materialize_small(ordinal.validate(ordinal.head_logits(test, head, vec), score_points, tolerance=tolerance))
        accuracy = metrics.filter("metric = 'exact_accuracy'").first()
        if accuracy is not None and accuracy["value"] > best[0]:
            best[:] = accuracy["value"], head
        return metrics

    def on_pass(i: int, head: OrdinalHead) -> None:
        if i % eval_every == 0:
            evaluated(head)

    head = ordinal.fit_thresholds(train, vec, "label_idx", len(score_points), reg_param, max_iter,
                                  score_points=score_points, on_pass=on_pass if eval_every else None)
    metrics = evaluated(head)
    spark = vectors.sparkSession
    metrics = metrics.unionByName(spark.createDataFrame([("best_accuracy", float(best[0]))], "metric string, value double"))
    if output:
        save_head(spark, head, f"{output}/model")
        if best[1] is not None:
            save_head(spark, best[1], f"{output}/best_model")
        write_metrics_json(metrics, f"{output}/metrics")
    return head, metrics


def score_table(answers: DataFrame, scorer_factory: Callable, output: str | None = None,
                id_col: str = "BMH", text_col: str = "text", batch_size: int = 16,
                fmt: str = "parquet", order: str | Sequence[str] | None = None,
                reference_layout: bool = False) -> tuple[DataFrame, DataFrame]:
    """Infer job (M5): require columns, score every row with a status, optionally write.

    ``order`` decides which rows share a batch, and so fail together.  ``None``: consecutive rows of a partition.  ``"input"``:
    the reference's batches, consecutive non-blank rows in the order of the input files (:func:`rubricon.operators.batch.score_in_scan_order`).  Column
    names: consecutive non-blank rows in the order of these columns.  ``reference_layout`` writes and returns the original column names and
    status texts (F4).  Returns ``(scored, status_counts)``; the counts always have the library's status names.
    """
    require_columns(answers, [id_col, text_col], "input table")
    if order is None:
        scored = batch.batch_score(answers, scorer_factory, text_col, batch_size)
    elif order == "input":
        scored = batch.score_in_scan_order(answers, scorer_factory, text_col, batch_size)
    else:
        cols = [order] if isinstance(order, str) else list(order)
        batched = batch.input_order_batches(answers, cols, text_col, batch_size, "_batch")
        scored = batch.batch_score(batched, scorer_factory, text_col, batch_size, "_batch", cols).drop("_batch")
    final = to_reference_layout(scored) if reference_layout else scored
    if output:
        write_scored(final, output, fmt)
        final = read_table(answers.sparkSession, output, fmt, schema=final.schema)
        scored = from_reference_layout(final) if reference_layout else final
    return final, batch.status_counts(scored)


def profile_table(df: DataFrame, text_col: str = "text", score_col: str = "pred_score") -> dict[str, DataFrame]:
    """Profile job (M6): length describe/histogram, and score describe/histogram and
    length-vs-score pairs when the score column exists.  The score column of the reference's own layout is
    taken when ``score_col`` is absent."""
    require_columns(df, [text_col], "profile input")
    if score_col not in df.columns and REFERENCE_SCORE_COL in df.columns:
        score_col = REFERENCE_SCORE_COL
    d, h = profile.length_profile(df, text_col)
    out = {"length_describe": d, "length_hist": h}
    sp = profile.score_profile(df, score_col)
    if sp is not None:
        out["score_describe"], hist = sp
        out["score_hist"] = profile.nonempty_bins(hist)
        out["length_vs_score"] = profile.length_vs_score(df, text_col, score_col)
    return out


def agreement_report(df: DataFrame, pred: str = "pred", label: str = "label",
                     group_cols: Sequence[str] = (), tolerance: float | None = None) -> dict[str, DataFrame]:
    """Metrics bundle, tolerance curve and contingency table from one contingency pass.

    The contingency table is checkpointed once (bounded), so the facts and
    anything upstream of them are processed once for all three outputs.
    """
    from rubricon.session import materialize_small

    ct, n_cells = materialize_small(agree.contingency(df, pred, label, group_cols))
    return {
        "contingency": ct,
        "metrics": agree.compute_metrics(ct, group_cols=group_cols, tolerance=tolerance, from_contingency=True,
                                         n_cells=n_cells),
        "tolerance_curve": agree.tolerance_curve(ct, group_cols=group_cols, from_contingency=True),
    }
