"""Stateful streams whose state ends: episodes with timers, session windows, and late labels.

Spark keeps state of ``transformWithState`` in RocksDB; ``prepare`` sets its provider.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from tarnforge.constants import EPISODE_DAYS, HORIZON_DAYS

_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_DAY_MS = 86_400_000


def prepare(spark: SparkSession) -> None:
    """The state store that ``transformWithState`` needs, for streams started after this."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)


class Episodes(StatefulProcessor):
    """Alerts of an entity wait until the watermark passes their day, and are then taken in order, so that the episodes don't
    depend on the order of arrival. State: waiting days and the day from which an episode may open, which is
    dropped once the watermark has passed it."""

    def __init__(self, key: str, duration: int):
        self.key, self.duration = key, duration

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "day int", "seen boolean")
        self.free = handle.getValueState("free", "day int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            for d in sorted({int(x) for x in frame.iloc[:, -1]}):  # the day; names of computed columns don't come along
                if not self.waiting.containsKey((d,)):
                    self.waiting.updateValue((d,), (True,))
                    self.handle.registerTimer(d * _DAY_MS)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        d = int(expiredTimerInfo.getExpiryTimeInMs()) // _DAY_MS
        free = self.free.get()[0] if self.free.exists() else None
        opens = self.waiting.containsKey((d,)) and (free is None or d >= free)
        if self.waiting.containsKey((d,)):
            self.waiting.removeKey((d,))
        if opens:
            free = d + self.duration
            self.free.update((free,))
        if free is not None and free * _DAY_MS <= timerValues.getCurrentWatermarkInMs():
            if not self.waiting.exists():  # all that comes from now on lies behind it
                self.free.clear()
        elif opens:
            self.handle.registerTimer(free * _DAY_MS)
        if opens:
            yield pd.DataFrame({self.key: [key[0]], "opened_day": pd.Series([d], dtype="int64")})

    def close(self) -> None:
        pass


def episodes(stream: DataFrame, key: str, at: str, score: str, tau: float, late: str, duration: int = EPISODE_DAYS) -> DataFrame:
    """Opened episodes (key, opened_day) of alerts at or above ``tau``, by the day of the timestamp ``at``. Rows may come in any
    order within ``late``. Entities without a waiting alert or a running episode have no state."""
    prepare(stream.sparkSession)
    kind = stream.schema[key].dataType.simpleString()
    alerts = stream.withWatermark(at, late).where(F.col(score) >= tau).select(key, at, F.unix_date(F.to_date(at)).alias("_day"))
    return alerts.groupBy(key).transformWithStateInPandas(Episodes(key, duration), f"{key} {kind}, opened_day long", "Append", "EventTime")


def sessions(stream: DataFrame, key: str, at: str, gap: str, late: str) -> DataFrame:
    """Runs of events of an entity with less than ``gap`` between neighbours: first and last time and their number, once the watermark
    has closed them."""
    g = stream.withWatermark(at, late).groupBy(F.session_window(at, gap), key)
    return g.agg(F.count("*").alias("n_events"), F.min(at).alias("first_at"), F.max(at).alias("last_at")).select(key, "first_at", "last_at", "n_events")


def late_labels(telemetry: DataFrame, failures: DataFrame, key: str, at: str, failed_at: str, late: str, horizon: int = HORIZON_DAYS) -> DataFrame:
    """Telemetry rows with the days to the first failure of their entity in the next ``horizon`` days (null: none), as failures
    come in on a stream of their own. A row is given once no failure can come any more; rows and failures are kept no longer."""
    t = telemetry.withWatermark(at, late)
    f = failures.select(F.col(key).alias("_key"), F.col(failed_at).alias("_failed")).withWatermark("_failed", late)
    days = F.datediff(F.to_date("_failed"), F.to_date(at))
    within = (F.col("_failed") >= F.col(at)) & (F.col("_failed") < F.col(at) + F.expr(f"INTERVAL {horizon + 1} DAYS"))
    j = t.join(f, (F.col(key) == F.col("_key")) & within, "left_outer")
    ahead = j.select(key, at, F.when(days.between(0, horizon), days).alias("days"))
    return ahead.groupBy(key, at).agg(F.min("days").alias("days_to_failure"))


def sentinel(spark: SparkSession, schema, values: dict) -> DataFrame:
    """One row far ahead in time, which moves the watermark past all that went before; for streams that end."""
    names = [f.name for f in schema.fields]
    row = tuple(values.get(c) for c in names)
    return spark.createDataFrame([row], schema)


#: A time beyond all data.
FAR = dt.datetime(2200, 1, 1)
