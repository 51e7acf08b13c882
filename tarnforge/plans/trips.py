"""Monthly trips: raw VARIANT records to typed, de-duplicated, imputed rows and a star schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnforge.constants import MIN_DONORS
from tarnforge.functions.keys import surrogate_key
from tarnforge.functions.scalar import flag, variant_field
from tarnforge.operators import clean, impute, joins, merge, profile, star

# Output column, record field, type.
FIELDS = (
    ("vendor_id", "VendorID", "decimal(38,0)"), ("pickup_datetime", "tpep_pickup_datetime", "timestamp_ntz"), ("dropoff_datetime", "tpep_dropoff_datetime", "timestamp_ntz"),
    ("passenger_count", "passenger_count", "decimal(38,0)"), ("trip_distance_miles", "trip_distance", "decimal(18,3)"), ("rate_code_id", "RatecodeID", "decimal(38,0)"),
    ("store_and_fwd_flag", "store_and_fwd_flag", "string"), ("pickup_location_id", "PULocationID", "decimal(38,0)"), ("dropoff_location_id", "DOLocationID", "decimal(38,0)"),
    ("payment_type", "payment_type", "decimal(38,0)"), ("fare_amount", "fare_amount", "decimal(18,2)"), ("extra_amount", "extra", "decimal(18,2)"), ("mta_tax_amount", "mta_tax", "decimal(18,2)"),
    ("tip_amount", "tip_amount", "decimal(18,2)"), ("tolls_amount", "tolls_amount", "decimal(18,2)"), ("improvement_surcharge_amount", "improvement_surcharge", "decimal(18,2)"),
    ("total_amount", "total_amount", "decimal(18,2)"), ("congestion_surcharge_amount", "congestion_surcharge", "decimal(18,2)"), ("airport_fee_amount", "Airport_fee", "decimal(18,2)"),
    ("cbd_congestion_fee_amount", "cbd_congestion_fee", "decimal(18,2)"),
)
# Code labels.
VENDORS = {1: "Creative Mobile Technologies, LLC", 2: "Curb Mobility, LLC", 6: "Myle Technologies Inc", 7: "Helix"}
RATES = {1: "Standard rate", 2: "JFK", 3: "Newark", 4: "Nassau or Westchester", 5: "Negotiated fare", 6: "Group ride", 99: "Null/unknown"}
PAYMENTS = {0: "Flex Fare trip", 1: "Credit card", 2: "Cash", 3: "No charge", 4: "Dispute", 5: "Unknown", 6: "Voided trip"}
# Names of the imputation methods; the parts of the surcharge total.
FINE, COARSE, MONTH = "mode_location_route_hour", "mode_location_payment", "mode_month"
SURCHARGES = ["mta_tax_amount", "improvement_surcharge_amount", "congestion_surcharge_amount", "airport_fee_amount", "cbd_congestion_fee_amount"]


def staged(raw: DataFrame) -> DataFrame:
    """Latest version of each source row, typed; what does not parse is null."""
    latest = merge.dedup_latest(raw, ["source_month", "source_row_number"], [F.col("loaded_at").desc(), F.col("source_content_key").desc_nulls_last(), F.col("source_file").desc()])
    fields = [variant_field(F.col("raw_record"), f, kind).alias(c) for c, f, kind in FIELDS]
    return latest.select(surrogate_key(F.col("source_month"), F.col("source_row_number")).alias("trip_id"), "source_month", "source_file", "source_row_number", "source_content_key", F.col("loaded_at").alias("source_loaded_at"), *fields)


def imputed(trips: DataFrame) -> DataFrame:
    """Usable trips with the passenger count filled by peer modes; imputed rows never donate."""
    ok = trips.where(clean.valid_trip("pickup_datetime", "dropoff_datetime", ["pickup_location_id", "dropoff_location_id"], "trip_distance_miles", "passenger_count"))
    ok = ok.withColumns({"_vendor": F.coalesce("vendor_id", F.lit(-1)), "_payment": F.coalesce("payment_type", F.lit(-1)), "_hour": F.hour("pickup_datetime")})
    coarse = ["source_month", "_vendor", "pickup_location_id", "_payment"]
    levels = [(FINE, [*coarse, "dropoff_location_id", "_hour"], MIN_DONORS), (COARSE, coarse, MIN_DONORS), (MONTH, ["source_month"], None)]
    out = impute.impute_hierarchical(ok, "passenger_count", levels).drop("_vendor", "_payment", "_hour")
    return out.withColumnsRenamed({"passenger_count": "passenger_count_observed"}).withColumnsRenamed({"passenger_count_imputed": "passenger_count", "passenger_count_method": "passenger_count_imputation_method", "passenger_count_was_missing": "passenger_count_was_imputed"})


def _fee(name: str, col: str) -> dict[str, Column]:
    missing = F.col(col).isNull()
    return {f"{col}_observed": F.col(col), f"{name}_was_missing": missing, f"{name}_missingness_method": F.when(missing, "not_imputed_rate_code_unknown").otherwise("reported")}


def silver(filled: DataFrame) -> DataFrame:
    """Resolved rows: rate and flag normalised with their observed values kept; unknown money stays null."""
    f, r = F.col("store_and_fwd_flag"), F.col("rate_code_id")
    out = filled.where(F.col("passenger_count").isNotNull()).withColumns({
        "trip_duration_seconds": F.timestamp_diff("SECOND", F.col("pickup_datetime"), F.col("dropoff_datetime")),
        "rate_code_id_observed": r, "rate_code_id": F.coalesce(r, F.lit(99)), "rate_code_id_was_missing": r.isNull(),
        "rate_code_id_normalization_method": F.when(r.isNull(), "source_null_mapped_to_unknown_99").otherwise("reported"),
        "store_and_fwd_flag_observed": f, "store_and_fwd_flag": F.when(f.isin("Y", "N"), f).otherwise("NOT_REPORTED"), "store_and_fwd_flag_was_missing": f.isNull(),
        "store_and_fwd_flag_normalization_method": F.when(f.isNull(), "source_null_mapped_to_not_reported").when(~f.isin("Y", "N"), "invalid_value_mapped_to_not_reported").otherwise("reported"),
        **_fee("congestion_surcharge", "congestion_surcharge_amount"), **_fee("airport_fee", "airport_fee_amount"),
    })
    return out


def load_silver(target: DataFrame, fresh: DataFrame) -> DataFrame:
    """Incremental upsert; boundary ties are processed again, which the unique key makes safe."""
    return merge.incremental(merge.reconcile_columns(fresh, target.columns, "sync_all_columns"), target, ["trip_id"], "source_loaded_at", strict=False)


def months(trips: DataFrame) -> DataFrame:
    return trips.groupBy("source_month").agg(F.min("source_loaded_at").alias("first_loaded_at"), F.max("source_loaded_at").alias("last_loaded_at"), F.count("*").alias("trip_count"))


def null_reports(stage: DataFrame, cols: list[str]) -> tuple[DataFrame, DataFrame]:
    return profile.null_profile(stage, ["source_month"], cols), profile.null_correlations(stage, ["source_month"], cols)


def dimensions(trips: DataFrame, zones: DataFrame) -> dict[str, DataFrame]:
    """The seven dimensions; ``zones``: LocationID, Borough, Zone, service_zone."""
    spark = trips.sparkSession
    file_key = surrogate_key(F.col("source_month"), F.col("source_file"), F.coalesce("source_content_key", F.lit("")), F.col("source_loaded_at"))
    files = trips.groupBy("source_month", "source_file", "source_content_key", "source_loaded_at").agg(F.count("*").alias("trip_count"))
    return {
        "date": star.date_dimension(trips.select(F.col("pickup_datetime").cast("date")), trips.select(F.col("dropoff_datetime").cast("date"))),
        "vendor": star.code_dimension(trips, "vendor_id", VENDORS, "vendor_key", "vendor_name"),
        "rate_code": star.code_dimension(trips, "rate_code_id", RATES, "rate_code_key", "rate_code_description").withColumn("is_unknown_rate_code", F.col("rate_code_key") == 99),
        "payment_type": star.code_dimension(trips, "payment_type", PAYMENTS, "payment_type_key", "payment_type_description"),
        "store_and_forward": star.values_dimension(spark, [(1, "Y", "Stored before sending"), (2, "N", "Sent at once"), (99, "NOT_REPORTED", "Not reported")], "store_and_fwd_key int, store_and_fwd_flag string, description string"),
        "location": zones.select(F.col("LocationID").cast("int").alias("location_key"), "Borough", "Zone", "service_zone"),
        "source_file": files.select(file_key.alias("source_file_key"), "source_month", "source_file", "source_content_key", "source_loaded_at", "trip_count"),
    }


def fact(trips: DataFrame, dims: dict[str, DataFrame]) -> DataFrame:
    """One row a trip; dates and locations play two roles. All joins are left joins on unique keys."""
    stored = F.when(F.col("store_and_fwd_flag") == "Y", 1).when(F.col("store_and_fwd_flag") == "N", 2).otherwise(99)
    key = lambda c: F.coalesce(F.col(c).cast("int"), F.lit(-1))
    day = lambda c: (F.year(c) * 10000 + F.month(c) * 100 + F.dayofmonth(c))
    file_key = surrogate_key(F.col("source_month"), F.col("source_file"), F.coalesce("source_content_key", F.lit("")), F.col("source_loaded_at"))
    out = joins.star_join(trips, [
        (dims["date"], "date_key", day("pickup_datetime"), "pickup_date_key"), (dims["date"], "date_key", day("dropoff_datetime"), "dropoff_date_key"),
        (dims["vendor"], "vendor_key", key("vendor_id"), "vendor_key"), (dims["rate_code"], "rate_code_key", key("rate_code_id"), "rate_code_key"),
        (dims["store_and_forward"], "store_and_fwd_key", stored, "store_and_fwd_key"), (dims["location"], "location_key", key("pickup_location_id"), "pickup_location_key"),
        (dims["location"], "location_key", key("dropoff_location_id"), "dropoff_location_key"), (dims["payment_type"], "payment_type_key", key("payment_type"), "payment_type_key"),
        (dims["source_file"], "source_file_key", file_key, "source_file_key"),
    ])
    return out.withColumns({
        "trip_count": F.lit(1), "trip_duration_minutes": F.round(F.col("trip_duration_seconds") / 60.0, 2), "total_tax_and_surcharge_amount": star.additive_total(SURCHARGES),
        "passenger_count_imputed_trip_count": flag(F.col("passenger_count_was_imputed")), "rate_code_unknown_trip_count": flag(F.col("rate_code_id") == 99),
        "airport_fee_missing_trip_count": flag(F.col("airport_fee_was_missing")), "congestion_surcharge_missing_trip_count": flag(F.col("congestion_surcharge_was_missing")),
    })


def fee_nulls_without_reason(trips: DataFrame) -> DataFrame:
    """Rows that fail: a fee is null although the rate code is known."""
    return trips.where((F.col("congestion_surcharge_amount").isNull() | F.col("airport_fee_amount").isNull()) & F.col("rate_code_id_observed").isNotNull())
