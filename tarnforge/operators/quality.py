"""Data-quality tests. Each returns the failing rows; none fails is a pass."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnforge.functions.scalar import all_null, any_of
from tarnforge.operators import sets, windows


def not_null(df: DataFrame, col: str) -> DataFrame:
    return df.where(F.col(col).isNull())


def unique(df: DataFrame, cols: list[str]) -> DataFrame:
    """Keys that repeat; null keys are not tested."""
    known = df.dropna(subset=cols)
    return known.groupBy(*cols).agg(F.count("*").alias("copies")).where("copies > 1")


def relationship(df: DataFrame, col: str, dim: DataFrame, key: str) -> DataFrame:
    """Non-null foreign keys without a dimension row."""
    return df.where(F.col(col).isNotNull()).join(dim.select(F.col(key).alias("_k")), F.col(col) == F.col("_k"), "left_anti")


def accepted_values(df: DataFrame, col: str, values: list) -> DataFrame:
    return df.where(F.col(col).isNotNull() & ~F.col(col).isin(values)).groupBy(col).agg(F.count("*").alias("row_count"))


def continuous_spine(df: DataFrame, day: str) -> DataFrame:
    return windows.gaps(df, day)


def covers(dim: DataFrame, source: DataFrame) -> DataFrame:
    """Business keys of the source that the dimension lacks."""
    return sets.difference(source, dim.select(*source.columns))


def same_row_count(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row with both counts where they differ."""
    return a.agg(F.count("*").alias("left_rows")).crossJoin(b.agg(F.count("*").alias("right_rows"))).where("left_rows <> right_rows")


def has_measurement(df: DataFrame, cols: list[str]) -> DataFrame:
    """Rows without any value."""
    return df.where(all_null(cols))


def no_measurement(df: DataFrame, cols: list[str]) -> DataFrame:
    """Quarantined rows that do have a value."""
    return df.where(~all_null(cols))


def paired_missingness(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    return df.where(any_of([F.col(a).isNull() != F.col(b).isNull() for a, b in pairs]))


def dimension_attribute(fact: DataFrame, dim: DataFrame, key: str, attribute: str, expected) -> DataFrame:
    return fact.join(dim.select(key, attribute), key).where(~F.col(attribute).eqNullSafe(F.lit(expected)))


def holds(df: DataFrame, rule: Column) -> DataFrame:
    """Rows for which a rule is not true; null is a failure."""
    return df.where(~F.coalesce(rule, F.lit(False)))


def columns_absent(df: DataFrame, forbidden: list[str]) -> list[str]:
    return sorted({c.upper() for c in df.columns} & {c.upper() for c in forbidden})


@dataclass(frozen=True)
class Check:
    """A test: its failing rows, or, of a test of single rows, the frame and the condition of failure."""

    name: str
    failures: DataFrame
    severity: str = "error"
    condition: Column | None = None


def report(checks: list[Check]) -> DataFrame:
    """All checks in one job: name, severity, failing rows, passed. Tests of the rows of one frame are
    counted in one pass over it."""
    parts, frames = [], {}
    for c in checks:
        if c.condition is None:
            parts.append(c.failures.agg(F.count("*").alias("failing_rows")).select(F.lit(c.name).alias("test_name"), F.lit(c.severity).alias("severity"), "failing_rows"))
        else:
            frames.setdefault(id(c.failures), []).append(c)
    for own in frames.values():
        counts = own[0].failures.agg(*[F.count_if(F.coalesce(c.condition, F.lit(False))).alias(f"_{i}") for i, c in enumerate(own)])
        rows = F.array(*[F.struct(F.lit(c.name).alias("test_name"), F.lit(c.severity).alias("severity"), F.col(f"_{i}").alias("failing_rows")) for i, c in enumerate(own)])
        parts.append(counts.select(F.inline(rows)))
    return sets.union_years(*parts).withColumn("passed", F.col("failing_rows") == 0)


def zero_gate(counters: dict[str, int | None]) -> None:
    """Every counter must be 0; null is ambiguous and fails as well."""
    bad = {k: v for k, v in counters.items() if v is None or int(v) != 0}
    if bad:
        raise ValueError(f"gate failed: {bad}")


#: Column of a tested stage: which tests a row fails, as bits.
FLAGS = "_failed_tests"


def flagged(df: DataFrame, tests: dict[str, Column]) -> DataFrame:
    """The frame with ``FLAGS``, for writing: tests of single rows are then taken in the pass that writes. ``tests``: at most 63
    names with the condition of failure (null is no failure)."""
    parts = [F.when(F.coalesce(c, F.lit(False)), F.lit(1 << k)).otherwise(0).cast("long") for k, c in enumerate(tests.values())]
    return df.withColumn(FLAGS, sum(parts, F.lit(0).cast("long")))


def flag_counts(stored: DataFrame, tests: list[str]) -> dict[str, int]:
    """row_count and the failing rows of each test, from the flags alone."""
    bit = lambda k: F.count_if(F.col(FLAGS).bitwiseAND(F.lit(1 << k)) != 0)
    return stored.agg(F.count("*").alias("row_count"), *[bit(k).alias(n) for k, n in enumerate(tests)]).first().asDict()
