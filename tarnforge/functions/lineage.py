"""Cutting lineage in the shared folder that the cluster names."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Narrow rows of a checkpoint file, where their number is known.
FILE_ROWS = 250_000


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where none is set, a local one does in local mode (tests); a
    cluster's executors would not see it, so there it is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tarnforge-checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and go on from those files.

    The files survive the loss of executors, and later plans read the same rows in the
    same partitions, which running sums over range partitions rely on. ``rows``: about how many
    narrow rows there are, where known; then there is a file for each ``FILE_ROWS`` of them, and not
    one for each partition of the shuffle.
    """
    ensure_checkpoint_dir(df.sparkSession)
    if rows is not None:
        df = df.coalesce(max(8, -(-rows // FILE_ROWS)))
    return df.checkpoint(eager=True)


def apart(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that shuffles both, whatever Spark takes its size for.

    Broadcast sides are collected by the driver. What a Python function or an explode makes of few rows is
    estimated by those rows, so a side of any size may be broadcast below spark.sql.autoBroadcastJoinThreshold.
    """
    return df.hint("merge")


def remove(spark: SparkSession, path: str) -> bool:
    """Deletes a folder where it lies; false if there is none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True))
