"""Ordinal-head column expressions: sigmoid, decode, loss terms, linear logits.

A K-class ordinal score is modelled by K-1 binary thresholds.  Threshold j
answers "is the class index above j?", so class k has the target pattern
``[1]*k + [0]*(K-1-k)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


TIE_EPS = 1e-9


def _c(x):
    return F.col(x) if isinstance(x, str) else x


def sigmoid(x: Column | str) -> Column:
    """Logistic function; exp overflow saturates to 0/1 without error."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_c(x)))


def sigmoid_array(logits: Column | str) -> Column:
    return F.transform(_c(logits), lambda x: F.lit(1.0) / (F.lit(1.0) + F.exp(-x)))


def _points_column(score_points: Column | str | Sequence[float]) -> Column:
    if isinstance(score_points, (list, tuple)):
        return F.array(*[F.lit(float(v)) for v in score_points])
    return _c(score_points)


def decode_index(probs: Column | str) -> Column:
    """0-based class index whose target pattern is nearest in L1 to ``probs``.

    Distances follow the prefix recurrence d_0 = sum(p), d_{k+1} = d_k + 1 - 2 p_k
    (valid for p in [0, 1]), one pass over the array.  A later index must be
    better by more than ``TIE_EPS``, so exact ties — which saturated 0/1 and 0.5
    probabilities produce — go to the lowest index whatever the summation order.
    Any NaN makes every distance NaN, in which case index 0 is returned; a null
    array, or one with a null element, gives null.
    """
    p = _c(probs).cast("array<double>")
    total = F.aggregate(p, F.lit(0.0), lambda acc, x: acc + x)
    init = F.struct(
        F.lit(0).alias("k"), total.alias("d"), total.alias("best_d"), F.lit(0).alias("best_k"))

    def step(acc, x):
        nd = acc["d"] + F.lit(1.0) - F.lit(2.0) * x
        better = nd < acc["best_d"] - F.lit(TIE_EPS)
        return F.struct(
            (acc["k"] + 1).alias("k"), nd.alias("d"),
            F.when(better, nd).otherwise(acc["best_d"]).alias("best_d"),
            F.when(better, acc["k"] + 1).otherwise(acc["best_k"]).alias("best_k"))

    idx = F.aggregate(p, init, step, lambda acc: acc["best_k"])
    has_nan = F.exists(p, lambda x: F.isnan(x))
    missing = p.isNull() | F.exists(p, lambda x: x.isNull())
    return F.when(missing, F.lit(None).cast("int")).when(has_nan, F.lit(0)).otherwise(idx)


def decode_scores(probs: Column | str, score_points: Column | str | Sequence[float]) -> Column:
    """Score point of the nearest threshold pattern (see :func:`decode_index`)."""
    pts = _points_column(score_points)
    idx = decode_index(probs)
    return F.when(idx.isNotNull(), F.element_at(pts, idx + 1))


def cumulative_targets(label_idx: Column | str, n_thresholds: int | Column) -> Column:
    """Binary targets ``[1.0 if label_idx > j else 0.0 for j in range(K-1)]``."""
    n = F.lit(n_thresholds) if isinstance(n_thresholds, int) else n_thresholds
    li = _c(label_idx)
    return F.transform(F.sequence(F.lit(0), n - 1),
                       lambda j: F.when(li > j, F.lit(1.0)).otherwise(F.lit(0.0)))


def bce_with_logits_sum(logits: Column | str, label_idx: Column | str) -> Column:
    """Sum over thresholds of the numerically stable binary cross-entropy with logits,
    ``max(x,0) - x*t + log1p(exp(-|x|))`` with target t = [label_idx > j]; null without a label."""
    x_arr = _c(logits).cast("array<double>")
    li = _c(label_idx)
    terms = F.transform(
        x_arr,
        lambda x, j: F.greatest(x, F.lit(0.0))
        - x * F.when(li > j, F.lit(1.0)).otherwise(F.lit(0.0))
        + F.log1p(F.exp(-F.abs(x))))
    return F.when(li.isNotNull(), F.aggregate(terms, F.lit(0.0), lambda a, b: a + b))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def linear_logits(vec: Column | str, coef: Sequence[Sequence[float]],
                  intercept: Sequence[float]) -> Column:
    """K-1 logits ``W @ vec + b`` as a JVM expression with the weights inlined.

    For small heads (the weights become literals of the plan); the usual path is the
    Arrow-batched numpy form in :mod:`rubricon.operators.ordinal`.  A null vector, or one with
    a null element, has null logits; a vector of another length raises.
    """
    v = _c(vec).cast("array<double>")
    dim = len(coef[0])
    rows = [F.lit(float(b)) + dot(v, F.array(*[F.lit(float(w)) for w in wrow]))
            for wrow, b in zip(coef, intercept)]
    wrong = F.raise_error(F.lit(f"vector length differs from the head input size {dim}")).cast("array<double>")
    whole = v.isNotNull() & ~F.exists(v, lambda x: x.isNull())
    return F.when(v.isNotNull() & (F.size(v) != dim), wrong).when(whole, F.array(*rows))
