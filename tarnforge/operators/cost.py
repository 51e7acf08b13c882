"""Costs per 1,000 entity-months, threshold sweeps and alert budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnforge.constants import EPISODE_DAYS
from tarnforge.operators import events as ev


def cost_per_1000(alerts: Column, hits: Column, events, exposure, k) -> Column:
    """False alarms cost 1 (late ones too), missed failures k."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(float(x))
    return 1000.0 * ((alerts - hits) + lit(k) * (lit(events) - hits)) / lit(exposure)


def sweep(curve: DataFrame, events: int, exposure: float, ks=range(1, 51)) -> DataFrame:
    """By k: the cheapest threshold (the highest of equals), or none (infinite) where no alert at all
    is as cheap."""
    spark = curve.sparkSession
    grid = curve.crossJoin(F.broadcast(spark.createDataFrame([(int(k),) for k in ks], "k int")))  # a fixed set of k
    grid = grid.withColumn("cost", cost_per_1000(F.col("alerts"), F.col("hits"), events, exposure, F.col("k")))
    best = grid.groupBy("k").agg(F.min_by(F.struct("tau", "cost", "alerts", "hits"), F.struct("cost", (-F.col("tau")).alias("t"))).alias("b"))
    idle = 1000.0 * F.col("k") * float(events) / float(exposure)
    on = F.col("b.cost") < idle
    return best.select(
        "k", F.when(on, F.col("b.tau")).otherwise(F.lit(float("inf"))).alias("tau"), F.round(F.when(on, F.col("b.cost")).otherwise(idle), 4).alias("cost"),
        F.when(on, F.col("b.alerts")).otherwise(0.0).cast("long").alias("alerts"), F.when(on, F.col("b.hits")).otherwise(0.0).cast("long").alias("hits"), F.round(idle, 4).alias("cost_without_model"),
    )


def apply_thresholds(df: DataFrame, key: str, day: str, score: str, chosen: list[tuple[int, float]], duration: int | None = EPISODE_DAYS) -> list[dict]:
    """Costs on other rows at thresholds chosen before; they are never tuned again. One curve for all."""
    taus = sorted({t for _, t in chosen if t < float("inf")}, reverse=True)
    got = {r.tau: (r.alerts, r.hits) for r in ev.curve(df, key, day, score, taus, duration).collect()} if taus else {}
    events, months = ev.anticipable(df, key).first()["events"], ev.exposure(df, key, day).first()["entity_months"]
    out = []
    for k, t in chosen:
        a, h = got.get(t, (0.0, 0.0))
        out.append({"k": k, "tau": t, "alerts": a, "hits": h, "cost": 1000.0 * ((a - h) + k * (events - h)) / months, "cost_without_model": 1000.0 * k * events / months})
    return out


def break_even(model: DataFrame, baseline: DataFrame) -> DataFrame:
    """Smallest k at which the model is cheaper; null if none."""
    j = model.select("k", F.col("cost").alias("m")).join(baseline.select("k", F.col("cost").alias("b")), "k")
    return j.where("m < b").agg(F.min("k").alias("break_even_k"))


def threshold_for_budget(curve: DataFrame, exposure: float, budget: float) -> DataFrame:
    """The threshold with the most alerts within a budget per 1,000 entity-months. No labels are used."""
    rate = 1000.0 * F.col("alerts") / float(exposure)
    ok = curve.withColumn("rate", rate).where(F.col("rate") <= budget + 1e-9)
    return ok.agg(F.max_by(F.struct("tau", "alerts", "rate"), F.struct("rate", (-F.col("tau")).alias("t"))).alias("b")).select(F.col("b.tau").alias("tau"), F.col("b.alerts").cast("long").alias("alerts"), F.round("b.rate", 4).alias("rate"))


def budgets_by_k(swept: DataFrame, exposure: float) -> DataFrame:
    """Alerts per 1,000 entity-months that each k chose."""
    return swept.select("k", F.round(1000.0 * F.col("alerts") / float(exposure), 4).alias("budget"))


def cost_at_budget(curve: DataFrame, events: int, exposure: float, budgets: DataFrame) -> DataFrame:
    """Costs on other rows at alert budgets (k, budget) chosen before. The threshold of each k is the one
    with the most alerts within its budget, for which no label is used; then the labels tell the
    cost. No threshold fits a budget of 0 or one below all rates."""
    c = curve.withColumn("rate", 1000.0 * F.col("alerts") / float(exposure))
    j = budgets.crossJoin(F.broadcast(c))  # a fixed set of k, and as many rows as thresholds
    fit = F.when((F.col("budget") > 0) & (F.col("rate") <= F.col("budget") + 1e-9), F.struct("rate", "tau", "alerts", "hits", "late"))
    b = j.groupBy("k", "budget").agg(F.max(fit).alias("b"))
    none = F.col("b").isNull()
    z = lambda c: F.when(none, 0.0).otherwise(F.col(f"b.{c}"))
    return b.select(
        "k", "budget", F.when(none, F.lit(float("inf"))).otherwise(F.col("b.tau")).alias("tau"), *[z(c).cast("long").alias(c) for c in ("alerts", "hits", "late")], F.round(z("rate"), 4).alias("rate"),
        F.round(cost_per_1000(z("alerts"), z("hits"), events, exposure, F.col("k")), 4).alias("cost"), F.round(1000.0 * F.col("k") * float(events) / float(exposure), 4).alias("cost_without_model"),
    )


def same_budget(scored: dict[str, DataFrame], key: str, day: str, score: str, budget: float, n: int = 200, duration: int | None = EPISODE_DAYS) -> list[dict]:
    """Several models at one budget: threshold without labels, then hits."""
    out = []
    for name, df in scored.items():
        months = ev.exposure(df, key, day).first()["entity_months"]
        c = ev.curve(df, key, day, score, ev.thresholds(df, score, n), duration)
        t = threshold_for_budget(c, months, budget).first()
        if t.tau is not None:
            out.append({"model": name, **ev.point(df, key, day, score, t.tau, duration=duration).first().asDict(), "tau": t.tau})
    return out
