"""Profiles from mergeable sketches that are kept by month, so that a new month reads no old rows.

A month has one row a column: exact counts, sums and bounds, a HyperLogLog sketch of distinct values and a KLL sketch of
quantiles. Sketches of any months are merged to a profile of all of them. Errors (three standard ones): distinct counts within
``DISTINCT_ERROR`` of the true count, the rank of a quantile within ``RANK_ERROR`` of the asked one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LG_K, KLL_K = 12, 400
#: 3 * 1.04 / sqrt(2**LG_K); three times the usual rank error of a KLL sketch of size 400, some 0.7 %.
DISTINCT_ERROR, RANK_ERROR = 3 * 1.04 / 2 ** (LG_K / 2), 0.021
_EXACT = {"row_count": F.sum, "known": F.sum, "total": F.sum, "squares": F.sum, "low": F.min, "high": F.max}


def monthly(df: DataFrame, date: str, cols: list[str]) -> DataFrame:
    """month, column_name, exact figures and sketches. One pass and one exchange of sketches."""
    parts = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("v")) for c in cols])
    long = df.select(F.trunc(date, "month").alias("month"), F.inline(parts))
    v = F.col("v")
    return long.groupBy("month", "column_name").agg(
        F.count("*").alias("row_count"), F.count(v).alias("known"), F.sum(v).alias("total"), F.sum(v * v).alias("squares"), F.min(v).alias("low"), F.max(v).alias("high"),
        F.hll_sketch_agg(F.when(v.isNotNull(), F.xxhash64(v)), LG_K).alias("distinct"), F.kll_sketch_agg_double(v, KLL_K).alias("quantiles"),
    )


def append(df: DataFrame, path: str, date: str, cols: list[str]) -> None:
    """Adds the sketches of the months in ``df``, in place of those that the path has of the same months."""
    monthly(df, date, cols).repartition("month").write.partitionBy("month").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def stored(spark: SparkSession, path: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Kept sketches of the months from start to end; other months' files are not opened."""
    out = spark.read.parquet(path)
    for bound, test in ((start, "__ge__"), (end, "__le__")):
        if bound is not None:
            out = out.where(getattr(F.col("month"), test)(F.lit(bound).cast("date")))
    return out


def merged(sketches: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row a column (and ``by``) of the sketches of several months."""
    exact = [f(c).alias(c) for c, f in _EXACT.items()]
    return sketches.groupBy(*(by or []), "column_name").agg(*exact, F.hll_union_agg("distinct").alias("distinct"), F.kll_merge_agg_double("quantiles").alias("quantiles"))


def quantile(q: float) -> Column:
    return F.when(F.col("known") > 0, F.kll_sketch_get_quantile_double("quantiles", F.lit(q)))


def grid(of: DataFrame, column: str, steps: int = 500) -> list[float]:
    """Quantiles of a column at equal steps of the rank: as many numbers as steps."""
    ranks = F.array(*[F.lit((k + 1) / steps) for k in range(steps)])
    row = of.where((F.col("column_name") == column) & (F.col("known") > 0)).select(F.kll_sketch_get_quantile_double("quantiles", ranks)).first()
    return list(row[0]) if row else []


def with_score(df: DataFrame, col: str, quantiles: list[float], name: str = "score") -> DataFrame:
    """Adds the share of the sketched values up to and with each value, within ``RANK_ERROR`` and a step of the grid."""
    known = np.sort(np.asarray(quantiles, dtype=float))

    @F.pandas_udf("double")
    def score(v: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(known, v.to_numpy(float), side="right") / max(len(known), 1)).where(v.notna() & (len(known) > 0))

    return df.withColumn(name, score(F.col(col).cast("double")))


def profile(of: DataFrame, quantiles: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """column_name, row_count, null_count, mean, deviation, low, high, n_unique (estimated), and the named quantiles."""
    mean = F.col("total") / F.nullif(F.col("known"), F.lit(0))
    spread = (F.col("squares") - F.col("total") * mean) / F.nullif(F.col("known") - 1, F.lit(0))
    return of.select(
        *(by or []), "column_name", "row_count", (F.col("row_count") - F.col("known")).alias("null_count"), mean.alias("mean"), F.sqrt(F.greatest(spread, F.lit(0.0))).alias("deviation"),
        "low", "high", F.hll_sketch_estimate("distinct").alias("n_unique"), *[quantile(q).alias(n) for n, q in quantiles.items()],
    )
