"""Row-level ranking metrics. Rows are first counted by score, so that ties cost one row and what is
sorted is the distinct scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnforge.operators.ranks import running_sums


def _by_score(df: DataFrame, score: str, target: str) -> DataFrame:
    g = df.where(F.col(score).isNotNull() & F.col(target).isNotNull()).groupBy(F.col(score).alias("s")).agg(F.sum(F.col(target).cast("long")).alias("pos"), F.count("*").alias("n"))
    out = running_sums(g, "s", {"tp": "pos", "seen": "n"}, descending=True)
    return out.select("s", "pos", "n", "tp", "seen", F.col("tp_all").alias("all_pos"), F.col("seen_all").alias("all_n"))


def average_precision(df: DataFrame, score: str, target: str) -> DataFrame:
    """Sum of precision times recall step over distinct scores."""
    c = _by_score(df, score, target)
    return c.agg(F.round(F.sum(F.col("pos") / F.col("all_pos") * F.col("tp") / F.col("seen")), 6).alias("average_precision"))


def pr_auc_trapezoid(df: DataFrame, score: str, target: str) -> DataFrame:
    """Trapezoids between neighbouring scores; each point knows the one before it from its own counts."""
    c = _by_score(df, score, target)
    r, p = F.col("tp") / F.col("all_pos"), F.col("tp") / F.col("seen")
    r0, seen0 = (F.col("tp") - F.col("pos")) / F.col("all_pos"), F.col("seen") - F.col("n")
    p0 = F.when(seen0 > 0, (F.col("tp") - F.col("pos")) / F.nullif(seen0, F.lit(0))).otherwise(1.0)
    return c.agg(F.round(F.sum((r - r0) * (p + p0) / 2), 6).alias("pr_auc"))


def roc_auc(df: DataFrame, score: str, target: str) -> DataFrame:
    """Rank sum with ties averaged."""
    c = _by_score(df, score, target)
    rank = F.col("all_n") - F.col("seen") + (F.col("n") + 1) / 2.0
    s = c.agg(F.sum(F.col("pos") * rank).alias("ranks"), F.max("all_pos").alias("p"), F.max("all_n").alias("n"))
    neg = F.col("n") - F.col("p")
    return s.select(F.round((F.col("ranks") - F.col("p") * (F.col("p") + 1) / 2.0) / F.nullif(F.col("p") * neg, F.lit(0)), 6).alias("roc_auc"))


def at_threshold(df: DataFrame, score: str, target: str, tau: float = 0.5, beta: float = 0.5) -> DataFrame:
    hit = F.col(score) >= tau
    g = df.agg(F.count_if(hit & (F.col(target) == 1)).alias("tp"), F.count_if(hit & (F.col(target) == 0)).alias("fp"), F.count_if(~hit & (F.col(target) == 1)).alias("fn"))
    z = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    b2 = beta * beta
    return g.select("tp", "fp", "fn", F.round(z(F.col("tp"), F.col("tp") + F.col("fp")), 6).alias("precision"), F.round(z(F.col("tp"), F.col("tp") + F.col("fn")), 6).alias("recall"),
                    F.round(z((1 + b2) * F.col("tp"), (1 + b2) * F.col("tp") + b2 * F.col("fn") + F.col("fp")), 6).alias("f_beta"))


def overfit_class(train, valid) -> F.Column:
    """Relative gap between training and validation: severe above 1.0, moderate above 0.3."""
    gap = (train - valid) / F.nullif(valid, F.lit(0.0))
    return F.when(gap > 1.0, "severe").when(gap > 0.3, "moderate").otherwise("ok")
