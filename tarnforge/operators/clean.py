"""Projections, scopes and row predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnforge.constants import WINDOW_DAYS, context_days
from tarnforge.functions.scalar import all_null


def attribute_columns(ids, prefixes=("n", "r")) -> list[str]:
    return [f"{p}_{i}" for i in ids for p in prefixes]


def typed_attributes(ids, kind: str = "decimal(38,6)", prefixes=("n", "r")) -> list[Column]:
    """Generated projection: tolerant casts of all attribute columns."""
    return [F.col(c).try_cast(kind).alias(c) for c in attribute_columns(ids, prefixes)]


def aliased(alias: str, cols: list[str]) -> list[Column]:
    return [F.col(f"{alias}.{c}").alias(c) for c in cols]


def split_all_null(df: DataFrame, cols: list[str]) -> tuple[DataFrame, DataFrame]:
    """Clean rows and quarantine of rows without any value; together they are the input."""
    return df.where(~all_null(cols)), df.where(all_null(cols))


def output_scope(df: DataFrame, date: str, start: str | None, end: str | None) -> DataFrame:
    """Dates from start to end, both included."""
    if start is not None:
        df = df.where(F.col(date) >= F.lit(start).cast("date"))
    return df if end is None else df.where(F.col(date) <= F.lit(end).cast("date"))


def context_scope(df: DataFrame, date: str, start: str | None, end: str | None, windows=WINDOW_DAYS, horizon: int | None = None) -> DataFrame:
    """The output scope widened by what windows and labels look at. A filter on the raw column, so
    that it reaches the scan."""
    before, after = context_days(windows, *([horizon] if horizon is not None else []))
    if start is not None:
        df = df.where(F.col(date) >= F.date_sub(F.lit(start).cast("date"), before))
    return df if end is None else df.where(F.col(date) <= F.date_add(F.lit(end).cast("date"), after))


def month_scope(df: DataFrame, month: str, date: str, start: str, end: str) -> DataFrame:
    """A date range with the partition predicate that follows from it, for pruning by month directory."""
    return df.where(F.col(month).between(start[:7], end[:7])).where(F.col(date).between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def first_entities(df: DataFrame, key: str, n: int) -> DataFrame:
    """Complete histories of the first n entities in key order (a development sample)."""
    return df.join(F.broadcast(df.select(key).distinct().orderBy(key).limit(n)), key, "left_semi")


def valid_trip(pickup: str, dropoff: str, zones: list[str], distance: str, passengers: str, last_zone: int = 265) -> Column:
    """Timestamps present and in order, known zones, distance not negative (null stays), passengers
    above 0 or unreported."""
    ok = F.col(pickup).isNotNull() & F.col(dropoff).isNotNull() & (F.col(pickup) <= F.col(dropoff))
    for z in zones:
        ok = ok & F.col(z).between(1, last_zone)
    return ok & (F.col(distance).isNull() | (F.col(distance) >= 0)) & (F.col(passengers).isNull() | (F.col(passengers) > 0))


def require_columns(df: DataFrame, wanted: list[str]) -> DataFrame:
    """Required columns by case-insensitive name, in the wanted order and spelling."""
    have = {c.upper(): c for c in df.columns}
    missing = [c for c in wanted if c.upper() not in have]
    if missing:
        raise ValueError(f"missing columns {missing}")
    return df.select(*[F.col(have[c.upper()]).alias(c) for c in wanted])


def exact_schema(df: DataFrame, expected: list[str], width: int | None = None) -> DataFrame:
    """Names, order and width, or an error."""
    if df.columns != list(expected) or (width is not None and len(df.columns) != width):
        raise ValueError(f"schema has {len(df.columns)} columns that differ from the {len(expected)} expected")
    return df


def forbid_columns(df: DataFrame, forbidden: set[str]) -> DataFrame:
    found = {c.upper() for c in df.columns} & {c.upper() for c in forbidden}
    if found:
        raise ValueError(f"forbidden columns {sorted(found)}")
    return df


def complete_cases(df: DataFrame, cols: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows without nulls, and an audit of rows before and after."""
    kept = df.dropna(subset=cols)
    ok = F.coalesce(*[F.when(F.col(c).isNull(), F.lit(0)) for c in cols], F.lit(1))
    return kept, df.agg(F.count("*").alias("rows_before"), F.coalesce(F.sum(ok), F.lit(0)).alias("rows_after"))
