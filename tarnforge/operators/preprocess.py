"""Numeric preprocessing fitted on training rows and applied as generated expressions."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnforge.constants import CRITICAL_IDS
from tarnforge.functions.scalar import finite, signed_log1p
from tarnforge.operators.ranks import running_sums


def n_degrading(ids=CRITICAL_IDS, prefix: str = "R", days: int = 30) -> Column:
    """How many critical attributes rise over a window; an unknown shift does not count."""
    return sum((F.coalesce((F.col(f"{prefix}_{i}_MEAN_SHIFT_{days}D") > 0).cast("int"), F.lit(0)) for i in ids), F.lit(0))


@dataclass
class Preprocessor:
    """Signed log1p, median imputation, standardisation; indicators of missing values.

    Two aggregates over the training rows, whatever the number of columns: medians and null counts,
    then mean and population variance after imputation. Columns without any value are dropped;
    a constant column has scale 1. ``exact`` false takes approximate medians in bounded memory.
    ``scale_indicators`` false leaves the indicators 0 and 1; ``log`` false leaves values unscaled.
    """

    exact: bool = True
    indicators: bool = True
    scale_indicators: bool = True
    log: bool = True
    stats: dict = field(default_factory=dict)

    def _value(self, c: str) -> Column:
        x = finite(F.col(c))
        return signed_log1p(x) if self.log else x

    def fit(self, df: DataFrame, cols: list[str]) -> Preprocessor:
        q = (lambda x: F.percentile(x, 0.5)) if self.exact else (lambda x: F.percentile_approx(x, 0.5, 10_000))
        row = df.agg(F.count("*").alias("_n"), *[e for c in cols for e in (q(self._value(c)).alias(f"m_{c}"), F.count(self._value(c)).alias(f"k_{c}"))]).first()
        kept = [c for c in cols if row[f"k_{c}"]]
        if not kept:
            return self
        filled = {c: F.coalesce(self._value(c), F.lit(row[f"m_{c}"])) for c in kept}
        two = df.agg(*[e for c in kept for e in (F.avg(filled[c]).alias(f"a_{c}"), F.stddev_pop(filled[c]).alias(f"s_{c}"))]).first()
        for c in kept:
            share = 1 - row[f"k_{c}"] / row["_n"]
            spread = two[f"s_{c}"] or 0.0
            self.stats[c] = {"median": row[f"m_{c}"], "mean": two[f"a_{c}"], "scale": spread if spread > 1e-12 else 1.0, "missing": share}
        return self

    def transform(self, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
        out = [F.col(c) for c in (keep if keep is not None else [c for c in df.columns if c not in self.stats])]
        for c, s in self.stats.items():
            out.append(((F.coalesce(self._value(c), F.lit(s["median"])) - s["mean"]) / s["scale"]).alias(c))
            if self.indicators and s["missing"] > 0:
                m = F.when(self._value(c).isNull(), 1.0).otherwise(0.0)
                if self.scale_indicators:
                    m = (m - s["missing"]) / ((s["missing"] * (1 - s["missing"])) ** 0.5 or 1.0)
                out.append(m.alias(f"{c}_missing"))
        return df.select(*out)

    def dumps(self) -> str:
        return json.dumps(self.stats, sort_keys=True)


def select_features(df: DataFrame, cols: list[str], most_null: float = 0.05) -> list[str]:
    """Columns with few nulls and more than one value, judged on training rows in one aggregate."""
    row = df.agg(F.count("*").alias("_n"), *[e for c in cols for e in (F.count(c).alias(f"k_{c}"), F.min(c).alias(f"l_{c}"), F.max(c).alias(f"h_{c}"))]).first()
    return [c for c in cols if row["_n"] and 1 - row[f"k_{c}"] / row["_n"] <= most_null and row[f"l_{c}"] != row[f"h_{c}"]]


def ecdf_score(train: DataFrame, df: DataFrame, col: str, name: str = "score") -> DataFrame:
    """Share of training values at or below the row's value; 0 for null or NaN.

    The cumulative counts are by distinct value. They are looked up by one equi-join with the
    distinct values of ``df``, ranked together, so that nothing is broadcast and no range join is
    needed; the hot values of ``df`` meet the join once.
    """
    x = F.when(F.isnan(F.col(col).cast("double")), None).otherwise(F.col(col).cast("double"))
    t = train.select(x.alias("v")).where("v IS NOT NULL")
    steps = t.groupBy("v").agg(F.count("*").alias("n"))
    asked = df.select(x.alias("v")).where("v IS NOT NULL").distinct().withColumn("n", F.lit(0).cast("long"))
    both = steps.unionByName(asked).groupBy("v").agg(F.sum("n").alias("n"))
    table = running_sums(both, "v", {"_upto": "n"}).select(F.col("v").alias("_v"), (F.col("_upto") / F.col("_upto_all")).alias(name))
    return df.withColumn("_x", x).join(table, F.col("_x") == F.col("_v"), "left").withColumn(name, F.coalesce(name, F.lit(0.0))).drop("_x", "_v")
