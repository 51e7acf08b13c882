"""Logistic regression by Newton steps on sufficient statistics.

A step is one pass: each task sums gradient and curvature of its rows to one small matrix, the matrices are added by
Spark, and the driver solves a system of as many unknowns as features. What is moved is the square of the
features and doesn't grow with the rows; rows are never gathered or sampled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnforge.operators.gram import rows_of
from tarnforge.operators.models import balanced_weight, guard_features


def _sums(x: np.ndarray, y: np.ndarray, w: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """Curvature, with the gradient as one more column and the log loss in its corner."""
    z = x @ beta
    p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
    n = x.shape[1]
    out = np.zeros((n + 1, n + 1))
    out[:n, :n] = x.T @ (x * (w * p * (1 - p))[:, None])
    out[:n, n] = x.T @ (w * (y - p))
    out[n, n] = (w * (np.logaddexp(0, z) - y * z)).sum()
    return out


def step_sums(rows: DataFrame, beta: np.ndarray) -> np.ndarray:
    """The sums over all rows of (x, y, w), x with its constant."""
    n = len(beta)

    def run(batches):
        total = np.zeros((n + 1, n + 1))
        for b in batches:
            if b.num_rows:
                total += _sums(rows_of(b.column(0)), *(b.column(k).to_numpy(zero_copy_only=False) for k in (1, 2)), beta)
        i, j = np.triu_indices(n + 1)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], ["i", "j", "s"])

    out = np.zeros((n + 1, n + 1))
    for r in rows.mapInArrow(run, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():  # one number a pair
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["s"]
    return out


class Logistic:
    """Least log loss of all rows with an L2 penalty on all but the constant. Rows with a null in a feature or the
    target take no part in the fit and have a null score."""

    def __init__(self, l2: float = 1.0, weighted: bool = True, steps: int = 25, tolerance: float = 1e-10):
        self.l2, self.weighted, self.steps, self.tolerance = l2, weighted, steps, tolerance

    def _vector(self) -> Column:
        return F.array(F.lit(1.0), *[F.col(c).cast("double") for c in self.cols])

    def fit(self, df: DataFrame, cols: list[str], target: str) -> Logistic:
        self.cols = guard_features(cols)
        known = df.dropna(subset=[*cols, target])
        rows = balanced_weight(known, target) if self.weighted else known.withColumn("class_weight", F.lit(1.0))
        rows = rows.select(self._vector().alias("x"), F.col(target).cast("double").alias("y"), F.col("class_weight").cast("double").alias("w"))
        beta, penalty = np.zeros(len(cols) + 1), self.l2 * np.diag([0.0] + [1.0] * len(cols))
        loss = lambda s, b: s[-1, -1] + 0.5 * b @ penalty @ b
        s = step_sums(rows, beta)
        for self.taken in range(1, self.steps + 1):
            move = np.linalg.lstsq(s[:-1, :-1] + penalty, s[:-1, -1] - penalty @ beta, rcond=None)[0]
            while True:  # a step that would raise the loss is halved
                new = step_sums(rows, beta + move)
                if loss(new, beta + move) <= loss(s, beta) + 1e-9 * abs(loss(s, beta)) or np.abs(move).max(initial=0) < self.tolerance:
                    break
                move /= 2
            beta, s = beta + move, new
            if np.abs(move).max(initial=0) < self.tolerance:
                break
        self.beta = beta
        return self

    def score(self, df: DataFrame) -> DataFrame:
        z = F.lit(float(self.beta[0]))
        for b, c in zip(self.beta[1:], self.cols):
            z = z + F.lit(float(b)) * F.col(c).cast("double")
        return df.withColumn("score", 1 / (1 + F.exp(-z)))

    def coefficients(self) -> dict[str, float]:
        return dict(zip(["constant", *self.cols], map(float, self.beta)))
