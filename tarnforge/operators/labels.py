"""Horizon labels with censoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnforge.constants import HORIZON_DAYS


def failure_summary(events: DataFrame, key: str, date: str) -> DataFrame:
    """First failure and number of failure events of each entity."""
    return events.groupBy(key).agg(F.min(date).alias("first_failure_date"), F.count("*").alias("failure_event_count"))


def last_seen(context: DataFrame, key: str, date: str) -> DataFrame:
    """Last observation; from the context, never from the output scope, or rows near its end would
    count as censored."""
    return context.groupBy(key).agg(F.max(date).alias("last_seen_date"))


def status(date: str, horizon: int = HORIZON_DAYS) -> Column:
    ahead = F.datediff(F.col("first_failure_date"), F.col(date))
    seen = F.datediff(F.col("last_seen_date"), F.col(date))
    return (
        F.when(ahead < 0, "POST_FAILURE").when(ahead == 0, "SAME_DAY_FAILURE")
        .when(ahead.between(1, horizon), "POSITIVE").when(seen >= horizon, "NEGATIVE").otherwise("CENSORED")
    )


def target(label: str = "label_status") -> Column:
    """1, 0, or null where the row is unusable."""
    return F.when(F.col(label) == "POSITIVE", 1).when(F.col(label) == "NEGATIVE", 0)


def label_horizon(obs: DataFrame, events: DataFrame, key: str, date: str, event_date: str, horizon: int = HORIZON_DAYS, context: DataFrame | None = None) -> DataFrame:
    """Adds first_failure_date, failure_event_count, last_seen_date, days_to_failure (signed),
    label_status and target. The first failure of an entity is authoritative."""
    j = obs.join(failure_summary(events, key, event_date), key, "left").join(last_seen(context if context is not None else obs, key, date), key, "left")
    j = j.withColumn("days_to_failure", F.datediff("first_failure_date", F.col(date)))
    return j.withColumn("label_status", status(date, horizon)).withColumn("target", target())
