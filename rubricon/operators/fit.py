"""Fitting all thresholds of an ordinal head at once.

Every threshold has its own weights and the loss is a mean over rows and thresholds, so the thresholds are
independent logistic regressions over the same vectors.  One pass over the data serves all of them: a task multiplies its
blocks of vectors with the weights of every threshold that is still moving and returns one loss and gradient for
each; Spark adds these up in two levels (a square root of the tasks' results each), and the driver takes a step for
every threshold.  A pass costs one read of the cached vectors, whatever the number of classes.  Short vectors
come with the second derivatives, so that a few Newton steps do; long ones take L-BFGS steps.  Both end at the one minimum of the convex loss.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MEMORY = 12                     # pairs of steps and gradients that L-BFGS remembers
ARMIJO = 1e-4
MAX_HALVINGS = 30
FEW_TASKS = 256                 # results of so many tasks are added up in one level
NEWTON_VALUES = 2_000_000       # second derivatives of all thresholds up to which a pass sums them (16 MB a task)


class Descent:
    """Newton or L-BFGS steps of one threshold, driven from outside: ``at`` is the point whose loss and gradient are wanted next."""

    def __init__(self, start: np.ndarray, curvature: float, tolerance: float):
        self.at, self.curvature, self.tolerance = start, curvature, tolerance
        self.x = self.f = self.g = self.direction = None
        self.step, self.halvings, self.done = 1.0, 0, False
        self.pairs: deque = deque(maxlen=MEMORY)

    def _towards(self, hessian: np.ndarray | None) -> np.ndarray:
        """Minus the inverse Hessian, or its estimate by the two-loop recursion, times the gradient."""
        if hessian is not None:
            return -np.linalg.solve(hessian + 1e-12 * np.eye(len(hessian)), self.g)
        q, used = self.g.copy(), []
        for s, y, rho in reversed(self.pairs):
            a = rho * (s @ q)
            q -= a * y
            used.append(a)
        if self.pairs:
            s, y, _ = self.pairs[-1]
            q *= (s @ y) / (y @ y)
        else:
            q /= self.curvature
        for (s, y, rho), a in zip(self.pairs, reversed(used)):
            q += (a - rho * (y @ q)) * s
        return -q

    def report(self, f: float, g: np.ndarray, hessian: np.ndarray | None = None) -> None:
        """Takes the loss and its derivatives at ``at`` and moves on."""
        if self.x is not None:
            slope = self.g @ self.direction
            if not f <= self.f + ARMIJO * self.step * slope + 1e-15 * abs(self.f):
                self.halvings += 1
                if self.halvings > MAX_HALVINGS:            # no descent left within rounding
                    self.at, self.done = self.x, True
                    return
                short = -slope * self.step / (2 * (f - self.f - slope * self.step)) if math.isfinite(f) else 0.1
                self.step *= min(max(short, 0.1), 0.5)
                self.at = self.x + self.step * self.direction
                return
            s, y = self.at - self.x, g - self.g
            if s @ y > 1e-300:
                self.pairs.append((s, y, 1.0 / (s @ y)))
        self.x, self.f, self.g = self.at, f, g
        self.step, self.halvings = 1.0, 0
        if np.abs(g).max() <= self.tolerance:
            self.done = True
            return
        self.direction = self._towards(hessian)
        self.at = self.x + self.direction


def _blocks(column, dim: int) -> np.ndarray:
    """An Arrow list column as one matrix; another length than ``dim`` fails the job."""
    import pyarrow.compute as pc

    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    if (lengths != dim).any():
        raise ValueError(f"vectors of different lengths: {dim} and {int(lengths[lengths != dim][0])}")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def pass_over(data: DataFrame, weights: np.ndarray, bias: np.ndarray, cuts: list[int], mean: np.ndarray,
              scale: np.ndarray, second: bool = False) -> dict[int, np.ndarray]:
    """Summed gradient (weights, then bias), loss and, if ``second``, second derivatives of each threshold in ``cuts`` at standardised vectors; one job.

    ``data`` has ``(vec array<double>, y int)``.
    """
    spark = data.sparkSession
    sent = spark.sparkContext.broadcast((weights, bias, np.array(cuts), mean, scale))
    dim = len(mean)

    def sums(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        w, b, cut, mu, sd = sent.value
        total = np.zeros((len(cut), dim + 2 + second * (dim + 1) ** 2))
        for rb in batches:
            if not rb.num_rows:
                continue
            x = (_blocks(rb.column(0), dim) - mu) / sd
            z = x @ w.T + b
            target = rb.column(1).to_numpy()[:, None] > cut
            p = 1.0 / (1.0 + np.exp(-np.clip(z, -700, 700)))
            residual = p - target
            total[:, :dim] += residual.T @ x
            total[:, dim] += residual.sum(axis=0)
            total[:, dim + 1] += (np.maximum(z, 0) - z * target + np.log1p(np.exp(-np.abs(z)))).sum(axis=0)
            if second:
                x1 = np.c_[x, np.ones(len(x))]
                for i, curve in enumerate((p * (1 - p)).T):
                    total[i, dim + 2:] += (x1.T @ (curve[:, None] * x1)).ravel()
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array(cut, pa.int32()), pa.array(np.full(len(cut), part), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))],
                                         names=["k", "part", "row"])

    tasks = data.rdd.getNumPartitions()
    added = Summarizer.sum(F.col("row")).alias("row")
    parts = data.select("vec", "y").mapInArrow(sums, "k int, part int, row array<double>").select("k", "part", array_to_vector("row").alias("row"))
    if tasks > FEW_TASKS:
        parts = parts.groupBy("k", F.col("part") % math.isqrt(tasks)).agg(added)
    rows = parts.groupBy("k").agg(added).select("k", vector_to_array("row").alias("row")).collect()
    sent.unpersist()
    return {r["k"]: np.array(r["row"]) for r in rows}


def thresholds(data: DataFrame, n_classes: int, counts: dict[int, int], reg_param: float, max_iter: int,
               tolerance: float = 1e-7, on_pass: Callable[[int, np.ndarray, np.ndarray], None] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Weights and intercepts minimising, for every threshold k, the mean logistic loss of ``y > k`` plus
    ``reg_param / 2`` times the squared weights.

    ``on_pass`` is called after every pass with its number and the weights and intercepts so far.
    ``counts`` has the rows of every class.  The driver holds some ``MEMORY`` copies of the head or one of the second derivatives, no data.  A threshold with rows on one side only gets
    zero weights and a smoothed log-odds intercept.
    """
    stats = data.agg(Summarizer.mean(array_to_vector("vec")).alias("m"), Summarizer.std(array_to_vector("vec")).alias("s")).first()
    mean, scale = stats["m"].toArray(), stats["s"].toArray()
    scale = np.where(scale > 0, scale, 1.0)
    dim, n = len(mean), sum(counts.values())
    tolerance /= max(1.0, float((np.abs(mean) + scale).max()))       # it holds for the gradient at the vectors as they are
    coef, intercept = np.zeros((n_classes - 1, dim)), np.zeros(n_classes - 1)
    moving: dict[int, Descent] = {}
    for k in range(n_classes - 1):
        pos = sum(c for y, c in counts.items() if y > k)
        if pos in (0, n):
            intercept[k] = math.log((pos + 0.5) / (n - pos + 0.5))
            continue
        p = pos / n
        moving[k] = Descent(np.r_[np.zeros(dim), math.log(p / (1 - p))], p * (1 - p), tolerance)
    every = dict(moving)
    second = len(moving) * (dim + 1) ** 2 <= NEWTON_VALUES

    def so_far() -> tuple[np.ndarray, np.ndarray]:
        for k, d in every.items():
            best = d.x if d.x is not None else d.at
            coef[k] = best[:dim] / scale
            intercept[k] = best[dim] - coef[k] @ mean
        return coef.copy(), intercept.copy()

    for i in range(max_iter):
        if not moving:
            break
        cuts = sorted(moving)
        at = np.array([moving[k].at for k in cuts])
        sums = pass_over(data, at[:, :dim], at[:, dim], cuts, mean, scale, second)
        for k in cuts:
            d, u = moving[k], moving[k].at[:dim]
            gradient = sums[k][:dim + 1] / n
            gradient[:dim] += reg_param * u / scale ** 2
            hessian = None
            if second:
                hessian = sums[k][dim + 2:].reshape(dim + 1, dim + 1) / n + np.diag(np.r_[reg_param / scale ** 2, 0.0])
            d.report(sums[k][dim + 1] / n + reg_param / 2 * float(((u / scale) ** 2).sum()), gradient, hessian)
            if d.done:
                del moving[k]
        if on_pass is not None:
            on_pass(i + 1, *so_far())
    return so_far()


def gradients(df: DataFrame, coef: np.ndarray, intercept: np.ndarray, vec: str, label_idx: str, reg_param: float) -> DataFrame:
    """``(threshold, positives, n_rows, steepest)``: the largest absolute entry of the regularised gradient of each threshold.

    Written as column expressions and sums of vectors, apart from the code of the fit: at a minimum every entry is zero.
    """
    spark = df.sparkSession
    heads = spark.createDataFrame([(k, [float(v) for v in coef[k]], float(intercept[k])) for k in range(len(coef))],
                                  "threshold int, w array<double>, b double")
    known = df.filter(F.col(label_idx).isNotNull() & F.col(vec).isNotNull() & ~F.exists(vec, lambda x: x.isNull()))
    x = known.select(F.col(vec).cast("array<double>").alias("x"), F.col(label_idx).alias("y"))
    each = x.select("x", "y", F.explode(F.array(*[F.lit(k) for k in range(len(coef))])).alias("threshold")).join(F.broadcast(heads), "threshold")
    z = F.aggregate(F.zip_with("x", "w", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v) + F.col("b")
    hit = (F.col("y") > F.col("threshold")).cast("double")
    each = each.select("threshold", hit.alias("hit"), "x", (F.lit(1.0) / (F.lit(1.0) + F.exp(-z)) - hit).alias("r"))
    pulled = F.concat(F.transform("x", lambda v: v * F.col("r")), F.array("r"))
    sums = each.groupBy("threshold").agg(vector_to_array(Summarizer.mean(array_to_vector(pulled))).alias("g"), F.sum("hit").cast("long").alias("positives"),
                                         F.count(F.lit(1)).alias("n_rows"))
    held = F.concat(F.transform("w", lambda v: v * F.lit(reg_param)), F.array(F.lit(0.0)))
    steepest = F.array_max(F.transform(F.zip_with("g", held, lambda a, b: a + b), lambda v: F.abs(v)))
    return sums.join(F.broadcast(heads), "threshold").select("threshold", "positives", "n_rows", steepest.alias("steepest"))
