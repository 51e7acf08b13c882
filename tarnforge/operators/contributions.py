"""Exact Shapley contributions of tree ensembles (the path-dependent form), without a library.

The value of a tree for a subset S of features is the leaves' mean, where splits on features of S are followed and others
are passed by the shares of training rows. A leaf counts by its path alone: of each feature on it only matters
whether the row meets all the path's conditions on it (one) and by what share unknown values do (share). So
a leaf of d features has 2**d cases, whose contributions are tabled once by the Shapley sum over subsets;
a row looks up its case in each leaf. Contributions and the base add up to the ensemble's value.
"""

from __future__ import annotations

from itertools import combinations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnforge.operators.gram import rows_of


class Leaf:
    """Value, and for each feature of the path its bounds (low, high] and share."""

    def __init__(self, value: float, bounds: dict[int, tuple[float, float]], share: dict[int, float]):
        self.features = sorted(bounds)
        self.low, self.high = (np.array([bounds[f][k] for f in self.features]) for k in (0, 1))
        share_of = np.array([share[f] for f in self.features])
        self.base = value * float(np.prod(share_of))
        d = len(self.features)
        self.table = np.zeros((1 << d, d))
        for case in range(1 << d):
            one = np.array([(case >> k) & 1 for k in range(d)], dtype=float)
            for j in range(d):
                others = [k for k in range(d) if k != j]
                total = 0.0
                for n in range(d):
                    weight = factorial(n) * factorial(d - n - 1) / factorial(d)
                    for inside in combinations(others, n):
                        if all(one[k] for k in inside):
                            total += weight * float(np.prod([share_of[k] for k in others if k not in inside]))
                self.table[case, j] = value * total * (one[j] - share_of[j])

    def add(self, x: np.ndarray, out: np.ndarray) -> None:
        """Adds the leaf's contributions for rows ``x`` to ``out``."""
        if self.features:
            v = x[:, self.features]
            case = ((v > self.low) & (v <= self.high)) @ (1 << np.arange(len(self.features)))
            out[:, self.features] += self.table[case]


def leaves(node, value) -> list[Leaf]:
    """Leaves of a fitted Spark tree's nodes. ``value`` gives a leaf's value; splits are of continuous features."""
    out = []

    def walk(at, bounds: dict, share: dict) -> None:
        if at.subtreeDepth() == 0:
            out.append(Leaf(value(at), bounds, share))
            return
        f, t = at.split().featureIndex(), at.split().threshold()
        n = at.leftChild().impurityStats().count(), at.rightChild().impurityStats().count()
        low, high = bounds.get(f, (-np.inf, np.inf))
        for k, (child, span) in enumerate(((at.leftChild(), (low, min(high, t))), (at.rightChild(), (max(low, t), high)))):
            walk(child, {**bounds, f: span}, {**share, f: share.get(f, 1.0) * n[k] / sum(n)})

    walk(node, {}, {})
    return out


def ensemble(model) -> list[Leaf]:
    """Leaves of a fitted forest or boosted classifier, with values that add up to the probability of class 1 (forest) or
    to the margin (boosting)."""
    trees = model.trees
    weights = list(model.treeWeights)
    boosted = type(model).__name__.startswith("GBT")
    out = []
    for tree, w in zip(trees, weights):
        part = w if boosted else 1.0 / len(trees)

        def value(at, part=part):
            if boosted:
                return part * at.prediction()
            s = list(at.impurityStats().stats())
            return part * s[1] / sum(s)

        out += leaves(tree._java_obj.rootNode(), value)
    return out


def contributions(df: DataFrame, vector: str, found: list[Leaf], features: int) -> DataFrame:
    """``df`` with ``contributions``, an array of one number a feature of the array column ``vector``, and ``base``."""
    spark = df.sparkSession
    base = sum(leaf.base for leaf in found)
    shared = spark.sparkContext.broadcast(found)  # as large as the model
    names = [*df.columns, "contributions"]
    at = df.columns.index(vector)

    def run(batches):
        for b in batches:
            x = rows_of(b.column(at))
            out = np.zeros((b.num_rows, features))
            if len(x):
                for leaf in shared.value:
                    leaf.add(x, out)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * features, pa.int32()), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns, lists], names)

    schema = df.withColumn("contributions", F.lit(None).cast("array<double>")).schema
    return df.mapInArrow(run, schema).withColumn("base", F.lit(base))


def importance(df: DataFrame, cols: list[str]) -> DataFrame:
    """column_name and its mean absolute contribution, of rows with ``contributions``."""
    parts = F.array(*[F.struct(F.lit(c).alias("column_name"), F.abs(F.get("contributions", F.lit(k))).alias("size")) for k, c in enumerate(cols)])
    return df.select(F.inline(parts)).groupBy("column_name").agg(F.avg("size").alias("mean_abs_contribution"))
