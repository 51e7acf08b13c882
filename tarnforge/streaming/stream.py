"""Streaming equivalents of the batch operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnforge.constants import EPISODE_DAYS
from tarnforge.functions.lineage import remove
from tarnforge.operators.merge import dedup_latest, merge_by_hash


def latest_once(stream: DataFrame, keys: list[str], at: str, late: str) -> DataFrame:
    """One row a key within the watermark: repeated deliveries are dropped, state is bounded."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def windowed_means(stream: DataFrame, key: str, at: str, value: str, size: str = "7 days", slide: str = "1 day", late: str = "1 day") -> DataFrame:
    """Sliding means and counts by event time."""
    g = stream.withWatermark(at, late).groupBy(F.window(at, size, slide), key)
    return g.agg(F.avg(value).alias("mean_value"), F.count(value).alias("n_values")).select(key, F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "mean_value", "n_values")


def late_rows(stream: DataFrame, at: str, arrived: str, late: str) -> DataFrame:
    """How many rows arrive later than the tolerance, by arrival day."""
    return stream.groupBy(F.to_date(arrived).alias("day")).agg(F.count("*").alias("row_count"), F.count_if(F.col(arrived) > F.col(at) + F.expr(f"INTERVAL {late}")).alias("late_rows"))


def episodes(stream: DataFrame, key: str, day: str, score: str, tau: float, duration: int = EPISODE_DAYS) -> DataFrame:
    """The episode state machine: one number of state an entity, the day from which it may open again.
    Rows of a micro-batch are taken in day order."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        free = state.get[0] if state.exists else -(2**31)
        rows = pd.concat(list(batches)).sort_values(day, kind="stable")
        opened = []
        for d, s in zip(rows[day], rows[score]):
            if s >= tau and d >= free:
                opened.append(int(d))
                free = int(d) + duration
        state.update((free,))
        yield pd.DataFrame({key: [k[0]] * len(opened), "opened_day": opened})

    kind = stream.schema[key].dataType.simpleString()
    live = stream.where(F.col(score).isNotNull()).select(key, F.col(day).cast("long").alias(day), F.col(score).cast("double").alias(score))
    return live.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, opened_day long", "free long", "append", "NoTimeout")


def versions(spark, root: str) -> list[int]:
    """Numbers of the versions of a table that are whole."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []
    done = lambda n: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{n}/_SUCCESS"))
    return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and done(n))


def latest_version(spark, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/v{versions(spark, root)[-1]}")


def upsert_sink(root: str, keys: list[str], hash_col: str, order: list, stamp: str | None = None, keep: int = 2):
    """A foreachBatch function: each micro-batch is merged with the last whole version before it into a new
    version folder, named by the batch, so that a repeated batch writes the same version again. A
    version holds the whole table: this is for tables of moderate size. ``keep`` versions stay."""

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        fresh, known = dedup_latest(batch, keys, order), [v for v in versions(spark, root) if v < epoch]
        out = merge_by_hash(spark.read.parquet(f"{root}/v{known[-1]}"), fresh, keys, hash_col, stamp) if known else fresh
        out.write.mode("overwrite").parquet(f"{root}/v{epoch}")
        for v in [*known, epoch][:-keep]:
            remove(spark, f"{root}/v{v}")

    return write
