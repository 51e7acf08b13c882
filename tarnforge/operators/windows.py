"""Calendar-range features. All expressions share one (partition, order): one exchange, one sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnforge.constants import WINDOW_DAYS
from tarnforge.operators.ranks import ordered


def frames(key: str, day: str, n: int):
    """The current window of n days and the adjacent one before it; days, not rows, so gaps count."""
    w = Window.partitionBy(key).orderBy(day)
    return w.rangeBetween(-(n - 1), 0), w.rangeBetween(-(2 * n - 1), -n)


def rolling(df: DataFrame, key: str, day: str, cols: list[str], windows=WINDOW_DAYS) -> DataFrame:
    """<col>_MEAN_nD, _COUNT_nD, _PREV_MEAN_nD, _PREV_COUNT_nD; nulls are skipped."""
    new = {}
    for n in windows:
        now, before = frames(key, day, n)
        for c in cols:
            new |= {f"{c}_MEAN_{n}D": F.avg(c).over(now), f"{c}_COUNT_{n}D": F.count(c).over(now), f"{c}_PREV_MEAN_{n}D": F.avg(c).over(before), f"{c}_PREV_COUNT_{n}D": F.count(c).over(before)}
    return df.select("*", *[e.alias(k) for k, e in new.items()])


def shift_columns(c: str, n: int) -> list[Column]:
    """Validity flags and mean shift, from the columns of ``rolling``."""
    now, before = F.col(f"{c}_COUNT_{n}D") > 0, F.col(f"{c}_PREV_COUNT_{n}D") > 0
    return [
        now.cast("int").alias(f"{c}_MEAN_VALID_{n}D"),
        F.when(now & before, F.col(f"{c}_MEAN_{n}D") - F.col(f"{c}_PREV_MEAN_{n}D")).alias(f"{c}_MEAN_SHIFT_{n}D"),
        (now & before).cast("int").alias(f"{c}_MEAN_SHIFT_VALID_{n}D"),
    ]


def with_shifts(df: DataFrame, cols: list[str], windows=WINDOW_DAYS) -> DataFrame:
    return df.select("*", *[e for n in windows for c in cols for e in shift_columns(c, n)])


def days_since_first_seen(df: DataFrame, key: str, date: str, name: str = "DAYS_SINCE_FIRST_SEEN") -> DataFrame:
    """Expanding minimum, so that later rows never change an earlier age."""
    w = Window.partitionBy(key).orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.datediff(F.col(date), F.min(date).over(w)))


def top_k(df: DataFrame, part: list[str], order: list[Column], k: int) -> DataFrame:
    """First k rows of each part; Spark pushes a window group limit below the shuffle."""
    w = Window.partitionBy(*part).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")


def lexsort(df: DataFrame, key: str, day: str, parts: int | None = None) -> DataFrame:
    """Rows of an entity together and in day order; no order between entities, hence no global sort."""
    return (df.repartition(parts, key) if parts else df.repartition(key)).sortWithinPartitions(key, day)


def gaps(df: DataFrame, day: str) -> DataFrame:
    """Days of a spine whose predecessor is not the day before; in ranges of days, not in one task."""
    return ordered(df, [F.col(day).asc()], "_place", {"previous": (day, 1)}).drop("_place").where(F.datediff(F.col(day), F.col("previous")) != 1)
