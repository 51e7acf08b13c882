"""Dimensions and facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnforge.functions.keys import date_key, surrogate_key
from tarnforge.functions.scalar import code_label, role_date_columns
from tarnforge.operators.sets import business_keys


def date_dimension(*dates: DataFrame) -> DataFrame:
    """A gap-free calendar over the bounds of one-column date frames."""
    bounds = [d.agg(F.min(d.columns[0]).alias("lo"), F.max(d.columns[0]).alias("hi")) for d in dates]
    b = bounds[0]
    for other in bounds[1:]:
        b = b.unionByName(other)
    b = b.agg(F.min("lo").cast("date").alias("lo"), F.max("hi").cast("date").alias("hi")).where("lo IS NOT NULL")
    d = b.select(F.explode(F.sequence("lo", "hi")).alias("full_date"))
    return d.select(date_key(F.col("full_date")).alias("date_key"), "full_date", *role_date_columns(F.col("full_date"), ""))


def entity_dimension(sources: list[DataFrame], keys: list[str], name: str) -> DataFrame:
    """Surrogate key and business key of every entity in any source."""
    k = business_keys(*[s.select(*keys) for s in sources])
    return k.select(surrogate_key(*[F.col(c) for c in keys]).alias(name), *keys)


def code_dimension(df: DataFrame, code: str, labels: dict[int, str], key: str, label: str) -> DataFrame:
    """Observed codes, null as -1, with their labels."""
    return df.select(F.coalesce(F.col(code).cast("int"), F.lit(-1)).alias(key)).distinct().withColumn(label, code_label(F.col(key), labels))


def values_dimension(df_session, rows: list[tuple], schema: str) -> DataFrame:
    """An inline dimension."""
    return df_session.createDataFrame(rows, schema)


def additive_total(cols: list[str]) -> Column:
    """Null if a part is null: an unknown component is not 0."""
    out = F.col(cols[0])
    for c in cols[1:]:
        out = out + F.col(c)
    return out
