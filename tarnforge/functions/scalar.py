"""Small column functions that the operators share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b as double; null for a zero denominator."""
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def percent(a: Column, b: Column, digits: int = 4) -> Column:
    return F.round(100.0 * ratio(a, b), digits)


def signed_log1p(x: Column) -> Column:
    return F.signum(x) * F.log1p(F.abs(x))


def finite(x: Column) -> Column:
    """NaN and infinities as null."""
    x = x.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def blank_to_null(x: Column) -> Column:
    return F.nullif(F.trim(x), F.lit(""))


def any_of(conditions: list[Column]) -> Column:
    """False for none."""
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def all_of(conditions: list[Column]) -> Column:
    """True for none."""
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def all_null(cols: list[str]) -> Column:
    return F.coalesce(*[F.col(c).cast("string") for c in cols]).isNull() if cols else F.lit(True)


def flag(x: Column) -> Column:
    """A boolean as an additive 0 or 1; null counts as 0."""
    return F.coalesce(x.cast("int"), F.lit(0))


def code_label(code: Column, labels: dict[int, str]) -> Column:
    """-1 is NOT_REPORTED; codes without a label are UNRECOGNIZED."""
    out = F.when(F.coalesce(code, F.lit(-1)) == -1, F.lit("NOT_REPORTED"))
    for k, v in labels.items():
        out = out.when(code == k, F.lit(v))
    return out.otherwise(F.lit("UNRECOGNIZED"))


def imputed_quadruple(observed: Column, filled: Column, method: Column, name: str) -> list[Column]:
    """Observed, normalised, was-missing and method columns of a field."""
    return [
        observed.alias(f"{name}_observed"), F.coalesce(observed, filled).alias(f"{name}_normalized"),
        observed.isNull().alias(f"{name}_was_missing"), F.when(observed.isNotNull(), F.lit("reported")).otherwise(method).alias(f"{name}_method"),
    ]


def variant_field(raw: Column, name: str, kind: str) -> Column:
    """A field of a VARIANT, tolerantly cast: null if absent, JSON null or unparsable."""
    text = F.try_variant_get(raw, f"$['{name}']", "string")
    if kind == "string":
        return blank_to_null(text)
    if kind == "timestamp_ntz":
        return F.try_to_timestamp(text).cast("timestamp_ntz")
    if kind.startswith("date:"):
        return F.try_to_date(text, kind[5:])
    return text.try_cast(kind)


def role_date_columns(d: Column, prefix: str) -> list[Column]:
    """Calendar attributes of a date; months and days by their English short names."""
    return [
        F.year(d).alias(f"{prefix}year"), F.quarter(d).alias(f"{prefix}quarter"), F.month(d).alias(f"{prefix}month"), F.date_format(d, "MMM").alias(f"{prefix}month_name"),
        F.dayofmonth(d).alias(f"{prefix}day"), F.weekofyear(d).alias(f"{prefix}iso_week"), (F.weekday(d) + 1).alias(f"{prefix}iso_weekday"), F.date_format(d, "E").alias(f"{prefix}day_name"),
        (F.weekday(d) >= 5).alias(f"{prefix}is_weekend"),
    ]
