"""Daily device telemetry: raw VARIANT records to typed rows, null policy, dimensions and facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnforge.constants import ATTRIBUTE_IDS, MODEL_IDS, RETAINED_IDS
from tarnforge.functions.keys import content_hash, date_key, surrogate_key
from tarnforge.functions.scalar import all_null, variant_field
from tarnforge.operators import clean, joins, merge, sets, star

LINEAGE = ["silver_record_id", "source_content_id", "source_archive", "source_file", "source_row", "source_date", "source_sha256", "ingested_at"]


def with_record_hash(raw: DataFrame) -> DataFrame:
    """SHA-256 of each record's JSON."""
    return raw.withColumn("source_sha256", F.sha2(F.to_json("raw_record"), 256))


def load_bronze(target: DataFrame, stage: DataFrame) -> DataFrame:
    """Upsert by archive, file and row: changed records replace, equal ones stay, none is deleted."""
    return merge.merge_by_hash(target, stage, ["source_archive", "source_file", "source_row"], "source_sha256", "ingested_at", F.current_timestamp(), null_safe=False)


def silver(raw: DataFrame, ids=ATTRIBUTE_IDS) -> DataFrame:
    """Typed rows: lineage, identity, all attributes by tolerant casts."""
    v = F.col("raw_record")
    return raw.select(
        surrogate_key(F.col("source_archive"), F.col("source_file"), F.col("source_row")).alias("silver_record_id"), surrogate_key(F.col("source_file"), F.col("source_sha256")).alias("source_content_id"),
        "source_archive", "source_file", "source_row", "source_date", "source_sha256", "ingested_at",
        variant_field(v, "disk_id", "decimal(38,0)").alias("disk_id"), variant_field(v, "ds", "date:yyyyMMdd").alias("observation_date"), variant_field(v, "model", "string").alias("model_code"),
        *[variant_field(v, c, "decimal(38,6)").alias(c) for c in clean.attribute_columns(ids)],
    )


def failure_labels(raw: DataFrame) -> DataFrame:
    v = F.col("raw_record")
    return raw.select(
        surrogate_key(F.col("source_archive"), F.col("source_file"), F.col("source_row")).alias("silver_record_id"), "ingested_at",
        variant_field(v, "disk_id", "decimal(38,0)").alias("disk_id"), variant_field(v, "model", "string").alias("model_code"), variant_field(v, "failure_time", "timestamp_ntz").alias("failure_time"),
    )


def null_policy(rows: DataFrame, ids=RETAINED_IDS, year: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Clean rows with the retained attributes, and the quarantine of rows without any, with reason."""
    cols = clean.attribute_columns(ids)
    keep = [*LINEAGE, "disk_id", "observation_date", "model_code"]
    good, bad = clean.split_all_null(rows, cols)
    return good.select(*keep, *cols), bad.select(*keep, F.lit(year).cast("short").alias("source_year"), F.lit("no_attributes").alias("quarantine_reason"))


def of_model(rows: DataFrame, model: str = "MC1", ids=MODEL_IDS) -> DataFrame:
    return rows.where(F.upper("model_code") == model).select(*LINEAGE, "disk_id", "observation_date", "model_code", *clean.attribute_columns(ids))


def all_years(*years: DataFrame) -> DataFrame:
    return sets.union_years(*years)


def dim_device(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """An id alone is no identity: the key is of id and model, from telemetry and failures."""
    return star.entity_dimension([rows, labels], ["disk_id", "model_code"], "ssd_key")


def dim_date(rows: DataFrame, labels: DataFrame) -> DataFrame:
    return star.date_dimension(rows.select("observation_date"), labels.select(F.col("failure_time").cast("date")))


def fact_daily(rows: DataFrame, devices: DataFrame, ids) -> DataFrame:
    """One row a device and day."""
    out = joins.count_preserving_join(rows, devices, ["disk_id", "model_code"])
    day = F.date_format("observation_date", "yyyy-MM-dd")
    return out.select(surrogate_key(F.col("ssd_key"), day).alias("smart_daily_key"), "ssd_key", "disk_id", "model_code", date_key(F.col("observation_date")).alias("observation_date_key"), "observation_date", *clean.attribute_columns(ids))


def fact_failure(labels: DataFrame, devices: DataFrame) -> DataFrame:
    out = joins.count_preserving_join(labels, devices, ["disk_id", "model_code"])
    return out.select(surrogate_key(F.col("ssd_key"), F.col("silver_record_id")).alias("failure_event_key"), "ssd_key", F.col("failure_time").cast("date").alias("failure_date"), date_key(F.col("failure_time")).alias("failure_date_key"), F.lit(1).cast("short").alias("failure_count"))


__all__ = ["all_years", "content_hash", "dim_date", "dim_device", "fact_daily", "fact_failure", "failure_labels", "load_bronze", "null_policy", "of_model", "silver", "with_record_hash"]
