"""Joins with guarantees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class JoinChangedRows(ValueError):
    """A join that must keep the row count did not."""


def count_preserving_join(df: DataFrame, dim: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join that must neither drop nor multiply rows. Checked on the dimension (unique keys) and by
    one anti-join, not by counting the result twice."""
    dup = dim.groupBy(*keys).count().where("count > 1").limit(1).count()
    lost = df.join(dim, keys, "left_anti").limit(1).count() if how == "inner" else 0
    if dup or lost:
        raise JoinChangedRows(f"{'repeated' if dup else 'unmatched'} keys {keys}")
    return df.join(dim, keys, how)


def orphans(df: DataFrame, dim: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(dim, keys, "left_anti")


def reference_errors(df: DataFrame, dim: DataFrame, key: str, value: str) -> DataFrame:
    """In one pass: rows whose key is unknown, and rows whose value differs from the dimension's."""
    d = dim.select(F.col(key).alias("_k"), F.col(value).alias("_v"))
    j = df.join(d, F.col(key) == F.col("_k"), "left")
    return j.agg(
        F.count_if(F.col("_k").isNull()).alias("orphan_rows"),
        F.count_if(F.col("_k").isNotNull() & ~F.col(value).eqNullSafe(F.col("_v"))).alias("mismatched_rows"),
    )


def exists_within(obs: DataFrame, events: DataFrame, keys: list[str], day: str, event_day: str, low: int, high: int, name: str, bucket: int | None = None) -> DataFrame:
    """Marks rows that have an event of the same keys at day + low to day + high: an existence band
    join, which never multiplies rows. Only distinct (keys, day) are probed, in buckets of epoch
    windows of the band's width, so that neither a hot key's rows nor its events meet in pairs."""
    width = bucket or max(1, high - low + 1)
    e = events.select(*keys, F.col(event_day).alias("_e")).where(F.col("_e").isNotNull()).distinct()
    e = e.withColumn("_b", F.floor(F.col("_e") / width)).groupBy(*keys, "_b").agg(F.collect_set("_e").alias("_days"))  # at most `width` days a bucket
    probe = obs.select(*keys, day).dropna().distinct()
    probe = probe.withColumn("_b", F.explode(F.sequence(F.floor((F.col(day) + low) / width), F.floor((F.col(day) + high) / width))))
    hit = F.exists("_days", lambda x: (x >= F.col(day) + low) & (x <= F.col(day) + high))
    found = probe.join(e, [*keys, "_b"]).where(hit).select(*keys, day).distinct().withColumn(name, F.lit(True))
    return obs.join(found, [*keys, day], "left").withColumn(name, F.coalesce(name, F.lit(False)))


def semi_range(obs_view: str, event_view: str, keys: list[str], day: str, event_day: str, low: int, high: int, name: str) -> str:
    """SQL of the same as a correlated EXISTS in the select list, which Spark plans as an existence
    join with the band as residual: the better plan where no key is hot."""
    on = " AND ".join(f"e.{k} = o.{k}" for k in keys)
    return f"SELECT o.*, EXISTS (SELECT 1 FROM {event_view} e WHERE {on} AND e.{event_day} BETWEEN o.{day} + {low} AND o.{day} + {high}) AS {name} FROM {obs_view} o"


def one_to_one(a: DataFrame, b: DataFrame, keys: list[str], suffixes: tuple[str, str] = ("_x", "_y")) -> DataFrame:
    """Inner join after both sides proved unique by keys; other common columns get suffixes."""
    for side in (a, b):
        if side.groupBy(*keys).count().where("count > 1").limit(1).count():
            raise JoinChangedRows(f"keys {keys} repeat")
    both = [c for c in a.columns if c in b.columns and c not in keys]
    return a.withColumnsRenamed({c: c + suffixes[0] for c in both}).join(b.withColumnsRenamed({c: c + suffixes[1] for c in both}), keys)


def fetch_wide(selected: DataFrame, wide: DataFrame, keys: list[str]) -> DataFrame:
    """Late materialisation: choose narrow keys first, then fetch the wide rows."""
    return wide.join(selected.select(*keys).distinct(), keys, "left_semi")


def star_join(fact: DataFrame, roles: list[tuple[DataFrame, str, Column, str]]) -> DataFrame:
    """Left joins of dimensions in roles: (dimension, its key, fact-side key expression, output key).
    The same dimension may serve several roles."""
    for i, (dim, dim_key, expression, out) in enumerate(roles):
        d = dim.select(F.col(dim_key).alias(f"_k{i}")).alias(f"d{i}")
        fact = fact.withColumn(f"_f{i}", expression).join(d, F.col(f"_f{i}") == F.col(f"_k{i}"), "left").withColumn(out, F.col(f"_k{i}")).drop(f"_k{i}", f"_f{i}")
    return fact


def rows_of_repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key occurs more than once."""
    n = df.groupBy(*keys).count().where("count > 1").select(*keys)
    return df.join(n, keys, "left_semi")


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, value: str, name: str) -> DataFrame:
    """Latest right value at or before each left row: one union, one sort, one window, no range join."""
    l = left.withColumn("_side", F.lit(1)).withColumn("_v", F.lit(None).cast(right.schema[value].dataType))
    r = right.select(F.col(key), F.col(at), F.col(value).alias("_v")).withColumn("_side", F.lit(0))
    w = Window.partitionBy(key).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    return l.unionByName(r, allowMissingColumns=True).withColumn(name, F.last("_v", ignorenulls=True).over(w)).where("_side = 1").drop("_side", "_v")
