"""Time splits with an embargo."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Fold:
    train_end: dt.date  # exclusive
    start: dt.date
    end: dt.date  # exclusive

    def train(self, df: DataFrame, date: str) -> DataFrame:
        return df.where(F.col(date) < F.lit(self.train_end))

    def validation(self, df: DataFrame, date: str) -> DataFrame:
        return df.where((F.col(date) >= F.lit(self.start)) & (F.col(date) < F.lit(self.end)))


def _month_shift(d: dt.date, months: int) -> dt.date:
    k = d.year * 12 + d.month - 1 + months
    return dt.date(k // 12, k % 12 + 1, 1)


def folds_between(first: dt.date, last: dt.date, n: int = 4, months: int = 2, embargo: int = 30) -> list[Fold]:
    """Expanding folds over the last n * months months; training ends ``embargo`` days before each."""
    end = _month_shift(last.replace(day=1), 1)
    out = []
    for i in range(n, 0, -1):
        start = _month_shift(end, -i * months)
        out.append(Fold(start - dt.timedelta(days=embargo), start, _month_shift(start, months)))
    if out[0].train_end <= first:
        raise ValueError("nothing lies before the embargo of the earliest fold")
    return out


def embargo_folds(df: DataFrame, date: str, n: int = 4, months: int = 2, embargo: int = 30) -> list[Fold]:
    b = df.agg(F.min(date).cast("date").alias("lo"), F.max(date).cast("date").alias("hi")).first()
    return folds_between(b.lo, b.hi, n, months, embargo)


def holdout(df: DataFrame, date: str, train_to: str, test_from: str, test_to: str, embargo: int = 30) -> tuple[DataFrame, DataFrame]:
    """Training up to a day, test from another, with more than ``embargo`` days between."""
    if (dt.date.fromisoformat(test_from) - dt.date.fromisoformat(train_to)).days <= embargo:
        raise ValueError("test begins before the embargo after training is over")
    d = F.col(date).cast("date")
    return df.where(d <= F.lit(train_to).cast("date")), df.where(d.between(F.lit(test_from).cast("date"), F.lit(test_to).cast("date")))


def three_way(date: Column, train_to: str, validation: tuple[str, str], test: tuple[str, str]) -> Column:
    """train, validation, test; null for the embargoed days between."""
    d = date.cast("date")
    between = lambda a: d.between(F.lit(a[0]).cast("date"), F.lit(a[1]).cast("date"))
    return F.when(d <= F.lit(train_to).cast("date"), "train").when(between(validation), "validation").when(between(test), "test")


def seen_entities(test: DataFrame, train: DataFrame, key: str) -> DataFrame:
    """Marks test rows whose entity occurs in training."""
    seen = train.select(key).distinct().withColumn("seen", F.lit(True))
    return test.join(seen, key, "left").withColumn("seen", F.coalesce("seen", F.lit(False)))
