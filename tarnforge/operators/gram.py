"""Sums of products of all pairs of a vector's components, by partial matrices of tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rows_of(column: pa.Array) -> np.ndarray:
    """An Arrow list column of vectors of one length as a matrix."""
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0))


def gram(df: DataFrame, vector: str, weight: str | None = None) -> DataFrame:
    """``(i, j, s)``, i <= j: the sum over all rows of weight * x[i] * x[j]. Vectors have one length and no nulls. A
    task sends one matrix of its rows, so that what is shuffled doesn't grow with them."""
    def run(batches):
        total = None
        for b in batches:
            x = rows_of(b.column(0))
            if len(x):
                part = x.T @ (x * b.column(1).to_numpy(zero_copy_only=False)[:, None] if b.num_columns > 1 else x)
                total = part if total is None else total + part
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], ["i", "j", "s"])

    cols = [F.col(vector).cast("array<double>")] + ([F.col(weight).cast("double")] if weight else [])
    return df.select(*cols).mapInArrow(run, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s"))
