"""Set operations and reconciliation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_years(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def business_keys(*frames: DataFrame) -> DataFrame:
    """Distinct keys over several sources; distinct before the union keeps the shuffle small."""
    return reduce(lambda a, b: a.union(b), [f.distinct() for f in frames]).distinct()


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of a that are not in b; nulls are equal."""
    return a.select(*b.columns).subtract(b)


def reconcile(expected: DataFrame, actual: DataFrame, multiset: bool = True) -> DataFrame:
    """Rows with an error: missing or unexpected. As sets, multiplicity goes unseen."""
    actual = actual.select(*expected.columns)
    minus = (lambda a, b: a.exceptAll(b)) if multiset else (lambda a, b: a.subtract(b))
    return minus(expected, actual).withColumn("error", F.lit("missing")).unionByName(minus(actual, expected).withColumn("error", F.lit("unexpected")))


def lossless_partition(source: DataFrame, *parts: DataFrame) -> DataFrame:
    """Errors of source = disjoint union of parts."""
    return reconcile(source, union_years(*[p.select(*source.columns) for p in parts]))


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Multiset parity; stops at the first difference on either side."""
    return a.exceptAll(b.select(*a.columns)).isEmpty() and b.select(*a.columns).exceptAll(a).isEmpty()
