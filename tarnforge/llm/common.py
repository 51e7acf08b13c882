"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnforge.functions.lineage import apart, cut, ensure_checkpoint_dir, remove

__all__ = ["apart", "cut", "ensure_checkpoint_dir", "free_name", "id_crc", "remove", "small_batches", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables; the path is only ever opened by Spark."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(columns: list[str], name: str) -> str:
    """``name``, with as many underscores before it as make it none of the columns."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def id_crc(col) -> F.Column:
    """crc32 of the id as text: the fixed rule by which rows are held out of training."""
    return F.crc32(col.cast("string"))


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch brings to a Python worker, however long the texts are, and the texts of
    plans that the driver keeps. The settings stay with the session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "256")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    spark.conf.set("spark.sql.maxPlanStringLength", str(1 << 14))
