"""Snapshots: Parquet by month with a manifest and a dataset hash; model cache; small exports."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class SnapshotError(ValueError):
    """A snapshot is not what its manifest says."""


def export(df: DataFrame, path: str, date: str, part: str = "mes", tasks_per_month: int = 1, order: list[str] | None = None) -> None:
    """Snappy Parquet by month in files of bounded rows. The rows of a month meet in ``tasks_per_month``
    tasks, so that there are few files, whatever the tasks of the scan.

    A shuffle hands rows over in any order, so the rows of a file are sorted by ``order`` (all columns that have an order, if
    none are named): the same rows give the same pages again. The optimizer removes a sort before the shuffle."""
    # Not null, under the name that Spark gives such a folder: else the writer wraps the column and sorts anew by it alone.
    months = df.withColumn(part, F.coalesce(F.date_format(F.col(date), "yyyy-MM"), F.lit("__HIVE_DEFAULT_PARTITION__")))
    months = months.repartition(F.col(part), *([F.pmod(F.xxhash64(*df.columns), F.lit(tasks_per_month))] if tasks_per_month > 1 else []))
    order = order or [f.name for f in df.schema if not any(t in f.dataType.simpleString() for t in ("map<", "variant", "interval"))]
    months = months.sortWithinPartitions(part, *order)
    months.write.partitionBy(part).option("compression", "snappy").option("maxRecordsPerFile", 4_000_000).mode("overwrite").parquet(path)


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """Relative path and SHA-256 of every Parquet file, hashed where it lies; other files are ignored.

    ``content_sha256`` is of the pages and Spark's schema only: a writer lists a column's encodings in its footer in the order
    of a hash set, which differs from one JVM to the next, so that executors write different bytes for the same rows."""
    root = path.rstrip("/").split(":", 1)[-1]
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(path)
    name = F.regexp_replace(F.substring_index("path", root, -1), "^/+", "")
    size = F.hex(F.substring("content", -8, 4))  # of the footer, its lowest byte first
    size = F.conv(F.concat(*[F.substring(size, k, 2) for k in (7, 5, 3, 1)]), 16, 10).cast("int")
    pages, footer = F.expr("length(content)") - 8 - size, F.col("content").substr(F.expr("length(content)") - 7 - size, size)
    schema = F.regexp_extract(F.decode(footer, "ISO-8859-1"), r'(?s)row\.metadata.*?(\{"type":"struct".*\]\})', 1)
    content = F.sha2(F.concat(F.sha2(F.col("content").substr(F.lit(1), pages), 256), schema), 256)
    return files.select(name.alias("file"), F.sha2("content", 256).alias("sha256"), content.alias("content_sha256"))


def dataset_hash(spark: SparkSession, path: str) -> str:
    """SHA-256 over the sorted ``file sha256`` lines; as many lines as files come to the driver."""
    lines = sorted(f"{r.file} {r.sha256}" for r in file_hashes(spark, path).select("file", "sha256").collect())
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


def manifest(spark: SparkSession, path: str, key: str, date: str, target: str, sql: str = "") -> dict:
    """Counts, dates, positives, entities (one aggregate) and hashes."""
    row = read(spark, path).agg(F.count("*").alias("rows"), F.min(date).cast("string").alias("first"), F.max(date).cast("string").alias("last"), F.count_if(F.col(target) == 1).alias("positives"), F.count_distinct(key).alias("entities")).first()
    return {**row.asDict(), "sql_sha256": hashlib.sha256(sql.encode()).hexdigest(), "dataset_sha256": dataset_hash(spark, path)}


def write_manifest(spark: SparkSession, path: str, content: dict) -> None:
    spark.createDataFrame([(json.dumps(content, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path.rstrip('/')}.manifest")


def read_manifest(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path.rstrip('/')}.manifest").first()[0])


def read(spark: SparkSession, path: str) -> DataFrame:
    """All months; the directory name is no column, as the date tells it."""
    return spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(path)


def load(spark: SparkSession, path: str, cols: list[str], date: str, key: str, start: str | None = None, end: str | None = None, verify: bool = True, ordered: bool = False) -> DataFrame:
    """Projection and date range that reach the scan; the hash is verified first."""
    if verify and read_manifest(spark, path)["dataset_sha256"] != dataset_hash(spark, path):
        raise SnapshotError("the files differ from the manifest")
    df = read(spark, path)
    if start:
        df = df.where(F.col(date) >= F.lit(start).cast("date"))
    if end:
        df = df.where(F.col(date) <= F.lit(end).cast("date"))
    df = df.select(*cols)
    return df.orderBy(date, key) if ordered else df


def reconcile_rows(spark: SparkSession, path: str, expected: int) -> None:
    """Rows from the Parquet footers: Spark answers this count without reading columns."""
    got = read(spark, path).count()
    if got != expected:
        raise SnapshotError(f"{got} rows exported, {expected} expected")


def model_cache(df: DataFrame, path: str, features: list[str], keep: list[str], date: str) -> None:
    """Float features sorted by date in each file, so that a date range reads few row groups."""
    df.select(*keep, *[F.col(c).cast("float").alias(c) for c in features]).repartitionByRange(F.col(date)).sortWithinPartitions(date).write.mode("overwrite").parquet(path)


def entity_cache(df: DataFrame, table: str, entity: str, date: str, buckets: int) -> DataFrame:
    """A table of the catalog in buckets of an entity, each sorted by entity and date: windows and joins by the entity read it
    without an exchange. A bucket is one file, so there are as many tasks; take as many as keep a bucket in a task's memory."""
    df.repartition(buckets, entity).write.bucketBy(buckets, entity).sortBy(entity, date).mode("overwrite").saveAsTable(table)
    return df.sparkSession.table(table)


def load_slice(spark: SparkSession, path: str, date: str, start: str, end: str, cols: list[str] | None = None) -> DataFrame:
    """The days from start to end of a model cache: row groups outside are skipped by their statistics."""
    df = spark.read.parquet(path).where(F.col(date).between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    return df.select(*cols) if cols else df


def months_of(spark: SparkSession, path: str, date: str):
    """(month, its rows) of a model cache, one month after the other."""
    for r in spark.read.parquet(path).select(F.trunc(date, "month").alias("m")).distinct().orderBy("m").collect():  # as many rows as months
        yield r["m"], spark.read.parquet(path).where((F.col(date) >= F.lit(r["m"])) & (F.col(date) < F.add_months(F.lit(r["m"]), 1)))


def float_columns(cols: list[str]) -> list[Column]:
    return [F.col(c).cast("float").alias(c) for c in cols]


def freeze(df: DataFrame, path: str, refresh: bool = False) -> DataFrame:
    """A write-once sample with the hash of its files: reused if it is there and unchanged."""
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    there = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    if refresh or not there:
        df.write.mode("overwrite").parquet(path)
        write_manifest(spark, path, {"dataset_sha256": dataset_hash(spark, path)})
    elif read_manifest(spark, path)["dataset_sha256"] != dataset_hash(spark, path):
        raise SnapshotError("the sample's files differ from their hash")
    return spark.read.parquet(path)


def export_csv(df: DataFrame, path: str, most: int = 1_000_000) -> None:
    """A result of at most ``most`` rows as one CSV file; a larger one is an error."""
    if df.limit(most + 1).count() > most:
        raise SnapshotError(f"more than {most} rows")
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def footer_nulls(path: str, cols: list[str]) -> dict[str, int] | None:
    """Null counts from the row-group statistics of local files, or None where some are missing."""
    import pyarrow.dataset as ds

    out = dict.fromkeys(cols, 0)
    for frag in ds.dataset(path, format="parquet").get_fragments():
        meta = frag.metadata
        at = {meta.schema.column(i).path: i for i in range(meta.num_columns)}
        for g in range(meta.num_row_groups):
            for c in cols:
                s = meta.row_group(g).column(at[c]).statistics
                if s is None or not s.has_null_count:
                    return None
                out[c] += s.null_count
    return out
