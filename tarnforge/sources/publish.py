"""Run-scoped stages, validated promotion, audit rows."""

from __future__ import annotations

import datetime as dt
import hashlib
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession

from tarnforge.functions.lineage import remove
from tarnforge.operators import quality

AUDIT_COUNTERS = (
    "source_rows", "output_rows", "entities", "positive_rows", "negative_rows", "censored_rows", "same_day_rows", "post_failure_rows",
    "duplicate_keys", "orphan_rows", "mismatched_rows", "label_errors", "window_errors", "parity_errors", "warnings",
)


def run_id(nonce: str, now: dt.datetime | None = None) -> str:
    return hashlib.sha256(f"{(now or dt.datetime.now(dt.UTC)).isoformat()}|{nonce}".encode()).hexdigest()


def stage_path(root: str, table: str, run: str) -> str:
    return f"{root.rstrip('/')}/_stages/{table}__run_{run[:12]}"


def write_stage(df: DataFrame, path: str) -> DataFrame:
    """Writes a run's own folder and reads it back: what is validated is what is on disk."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def write_tested(df: DataFrame, path: str, tests: dict[str, Column]) -> tuple[DataFrame, dict[str, int]]:
    """Writes a stage whose rows are tested in the same pass, by flags beside them; the counts are then read from the flags'
    column alone. Returns the rows on disk without their flags, and the counts. Where a test fails the stage stays
    for inspection, flags and all, and the error names the tests."""
    stored = write_stage(quality.flagged(df, tests), path)
    counts = quality.flag_counts(stored, list(tests))
    quality.zero_gate({n: counts[n] for n in tests})
    return stored.drop(quality.FLAGS), counts


def _folder(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _pointers(spark: SparkSession, root: str, table: str) -> list[str]:
    fs, at = _folder(spark, f"{root.rstrip('/')}/_pointers/{table}")
    return sorted(f.getPath().getName() for f in fs.listStatus(at) if f.getPath().getName().startswith("p-")) if fs.exists(at) else []


def promote(spark: SparkSession, stage: str, view: str, root: str, table: str) -> None:
    """Publishes a validated stage. The pointer is a small file that is written under a hidden name and
    then renamed to the next number: a reader finds the file before it or this one, whole, at any time.
    Then the view is replaced. The data is not copied, and older pointers stay, to go back to."""
    known = _pointers(spark, root, table)
    name = f"p-{int(known[-1].split('-')[1]) + 1 if known else 0:08d}-{uuid.uuid4().hex[:12]}"
    fs, folder = _folder(spark, f"{root.rstrip('/')}/_pointers/{table}")
    fs.mkdirs(folder)
    hidden, final = (spark._jvm.org.apache.hadoop.fs.Path(folder, n) for n in (f".{name}", name))
    out = fs.create(hidden, True)
    out.write(bytearray(stage.encode()))
    out.close()
    if not fs.rename(hidden, final):
        raise OSError(f"the pointer of {table} can't be renamed")
    open_published(spark, root, table).createOrReplaceTempView(view)


def open_published(spark: SparkSession, root: str, table: str) -> DataFrame:
    """The rows of the last pointer."""
    last = _pointers(spark, root, table)[-1]
    return spark.read.parquet(spark.read.text(f"{root.rstrip('/')}/_pointers/{table}/{last}").first()[0])


def rebuild(df: DataFrame, root: str, table: str, view: str, nonce: str) -> DataFrame:
    """A full rebuild of a table: a new stage beside the one that is read, then promoted."""
    path = stage_path(root, table, run_id(nonce))
    write_stage(df, path)
    promote(df.sparkSession, path, view, root, table)
    return open_published(df.sparkSession, root, table)


def drop_stages(spark: SparkSession, paths: list[str], succeeded: bool) -> int:
    """Removes stages of a run that succeeded; those of a failed run stay for inspection."""
    return sum(remove(spark, p) for p in paths) if succeeded else 0


def redact(message: str) -> str:
    """An error text without credentials."""
    return re.sub(r"(?i)(password|token|secret|key)\s*[=:]\s*\S+", r"\1=***", message)[:2000]


def audit(spark: SparkSession, path: str, run: str, status: str, counters: dict[str, int], error: str | None = None) -> None:
    """Appends one row: run, status, 15 nullable counters, error."""
    schema = "run_id string, status string, " + ", ".join(f"{c} long" for c in AUDIT_COUNTERS) + ", error string, finished_at timestamp"
    row = (run, status, *[counters.get(c) for c in AUDIT_COUNTERS], redact(error) if error else None, dt.datetime.now(dt.UTC))
    spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(path)
