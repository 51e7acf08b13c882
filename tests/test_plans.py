"""The wide table's contract, the trip and telemetry layers, and the streaming equivalents."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tarnforge.constants import ATTRIBUTE_IDS, MODEL_IDS, RETAINED_IDS
from tarnforge.operators import events, merge, quality
from tarnforge.plans import telemetry, trips, wide_table
from tarnforge.sources import publish
from tarnforge.streaming import stream


def rows(df):
    return [r.asDict() for r in df.collect()]


# ---- wide table


def facts(spark, days, ids=MODEL_IDS, entity="ssd-1"):
    start = dt.date(2018, 1, 1)
    data = [(f"key-{entity}-{k}", entity, 1, "MC1", int((start + dt.timedelta(k)).strftime("%Y%m%d")), start + dt.timedelta(k)) for k in days]
    df = spark.createDataFrame(data, "SMART_DAILY_KEY string, SSD_KEY string, DISK_ID long, MODEL_CODE string, OBSERVATION_DATE_KEY int, OBSERVATION_DATE date")
    return df.select("*", *[F.lit(i % 3 + 1).cast("decimal(38,6)").alias(f"{r}_{i}") for r in ("R", "N") for i in ids])


def failure(spark, date="2018-01-20", entity="ssd-1"):
    return spark.createDataFrame([(entity, dt.date.fromisoformat(date))], "SSD_KEY string, FAILURE_DATE date")


def test_contract(spark):
    spec = wide_table.Spec()
    out = wide_table.build(facts(spark, [0, 1]), failure(spark), spec)
    assert (len(out.columns), len(set(out.columns)), len(spec.columns(("R",))), len(spec.columns(("N",)))) == (847, 847, 429, 429)
    assert out.columns[:6] == list(wide_table.IDENTITY) and out.columns[-5:] == list(wide_table.LABEL)
    assert out.columns[6:25] == ["R_1", *(f"R_1_{p}_{n}D" for p in wide_table.FAMILY for n in (7, 14, 30))]
    got = rows(out.orderBy("OBSERVATION_DATE").select("R_1_COUNT_7D", "R_1_PREV_COUNT_7D", "LABEL_STATUS", "TARGET_30D", "DAYS_TO_FAILURE", "R_1_MEAN_SHIFT_7D"))
    assert [(r["R_1_COUNT_7D"], r["R_1_PREV_COUNT_7D"]) for r in got] == [(1, 0), (2, 0)]
    assert [(r["LABEL_STATUS"], r["TARGET_30D"], r["DAYS_TO_FAILURE"], r["R_1_MEAN_SHIFT_7D"]) for r in got] == [("POSITIVE", 1, 19, None), ("POSITIVE", 1, 18, None)]


SMALL = wide_table.Spec(ids=(1, 5))


def test_scopes_do_not_change_rows(spark):
    f = facts(spark, range(0, 120), SMALL.ids)
    full = wide_table.build(f, failure(spark, "2018-04-20"), SMALL).where("OBSERVATION_DATE BETWEEN '2018-03-10' AND '2018-03-20'")
    part = wide_table.build(f, failure(spark, "2018-04-20"), SMALL, "2018-03-10", "2018-03-20")
    assert part.exceptAll(full.drop("LAST_SEEN_DATE").join(part.select("SMART_DAILY_KEY", "LAST_SEEN_DATE"), "SMART_DAILY_KEY").select(*part.columns)).isEmpty() and part.count() == 11


def test_run_publishes_and_audits(spark, tmp_path):
    root = str(tmp_path)
    got = wide_table.run(spark, facts(spark, range(70), SMALL.ids), failure(spark), root, "n1", SMALL)
    assert got["OUTPUT_ROWS"] == 70 and got["POST_FAILURE_ROWS"] == 50 and got["SAME_DAY_FAILURE_ROWS"] == 1
    assert spark.table("obt_rn").count() == 70 and publish.open_published(spark, root, "obt_r").columns == SMALL.columns(("R",))
    wide_table.run(spark, facts(spark, range(5), SMALL.ids), failure(spark), root, "n2", SMALL, entities=1)
    assert publish.open_published(spark, root, "obt_rn").count() == 70  # a bounded run is not published
    with pytest.raises(wide_table.ValidationError):
        wide_table.run(spark, facts(spark, [0, 0], SMALL.ids), failure(spark), root, "n3", SMALL)
    assert sorted(r["status"] for r in rows(spark.read.parquet(f"{root}/_audit"))) == ["failed", "published", "validated"]


def test_validation_catches_errors(spark):
    good = wide_table.build(facts(spark, range(40), SMALL.ids), failure(spark), SMALL)
    wide_table.validate(good, SMALL)
    for c, v in (("R_1_COUNT_7D", F.lit(8)), ("N_5_MEAN_14D", F.lit(None).cast("decimal(38,10)")), ("R_5_MEAN_SHIFT_VALID_30D", F.lit(1) - F.col("R_5_MEAN_SHIFT_VALID_30D")), ("LABEL_STATUS", F.lit("NEGATIVE")), ("SSD_KEY", F.lit(None).cast("string"))):
        with pytest.raises(wide_table.ValidationError):
            wide_table.validate(good.withColumn(c, v), SMALL)
    with pytest.raises(ValueError):
        wide_table.validate(good.select(*reversed(good.columns)), SMALL)
    with pytest.raises(wide_table.ValidationError):
        wide_table.check_registry([*good.columns, "R_999"], SMALL)


# ---- trips

RECORD = {"VendorID": 1, "tpep_pickup_datetime": "2025-01-05T10:00:00", "tpep_dropoff_datetime": "2025-01-05T10:20:00", "passenger_count": 1, "trip_distance": 2.5, "RatecodeID": 1, "store_and_fwd_flag": "N", "PULocationID": 10, "DOLocationID": 20,
          "payment_type": 1, "fare_amount": 10, "extra": 1, "mta_tax": 0.5, "tip_amount": 2, "tolls_amount": 0, "improvement_surcharge": 1, "total_amount": 14.5, "congestion_surcharge": 2.5, "Airport_fee": 0, "cbd_congestion_fee": 0.75}


def raw_trips(spark, records):
    """(row number, changes, load hour, content key)"""
    data = [("2025-01", "f.parquet", n, key, json.dumps({**RECORD, **changes}), dt.datetime(2025, 2, 1, hour)) for n, changes, hour, key in records]
    df = spark.createDataFrame(data, "source_month string, source_file string, source_row_number long, source_content_key string, j string, loaded_at timestamp")
    return df.withColumn("raw_record", F.parse_json("j")).drop("j")


def test_trips(spark):
    records = [(k, {}, 0, "k") for k in range(20)]
    records += [
        (100, {"passenger_count": 9}, 0, "a"), (100, {"passenger_count": 4}, 1, "a"), (101, {"passenger_count": 2}, 0, None), (101, {"passenger_count": 3}, 0, "z"),
        (102, {"fare_amount": "oops", "store_and_fwd_flag": "  "}, 0, "k"), (103, {"tpep_dropoff_datetime": "2025-01-05T09:00:00"}, 0, "k"), (104, {"PULocationID": 0}, 0, "k"), (105, {"PULocationID": 265}, 0, "k"), (106, {"DOLocationID": 266}, 0, "k"),
        (107, {"trip_distance": -1}, 0, "k"), (108, {"trip_distance": None}, 0, "k"), (109, {"passenger_count": 0}, 0, "k"), (110, {"passenger_count": None}, 0, "k"), (111, {"RatecodeID": None, "congestion_surcharge": None}, 0, "k"),
        (112, {"Airport_fee": None, "VendorID": None, "payment_type": 77, "store_and_fwd_flag": "Q"}, 0, "k"),
    ]
    stage = trips.staged(raw_trips(spark, records))
    assert stage.count() == 20 + 13 and {r["source_row_number"]: r["passenger_count"] for r in rows(stage.where("source_row_number IN (100, 101)"))} == {100: 4, 101: 3}
    silver = trips.silver(trips.imputed(stage)).cache()
    got = {r["source_row_number"]: r for r in rows(silver)}
    assert sorted(k for k in got if k >= 100) == [100, 101, 102, 105, 108, 110, 111, 112]
    assert got[110]["passenger_count"] == 1 and got[110]["passenger_count_imputation_method"] == trips.FINE and got[110]["passenger_count_was_imputed"]
    assert got[102]["fare_amount"] is None and got[102]["store_and_fwd_flag"] == "NOT_REPORTED" and got[102]["store_and_fwd_flag_normalization_method"] == "source_null_mapped_to_not_reported"
    assert got[112]["store_and_fwd_flag_normalization_method"] == "invalid_value_mapped_to_not_reported" and got[111]["rate_code_id"] == 99 and got[111]["rate_code_id_observed"] is None
    assert [r["source_row_number"] for r in rows(trips.fee_nulls_without_reason(silver))] == [112]
    zones = spark.createDataFrame([(k, "B", "Z", "S") for k in range(1, 266)], "LocationID int, Borough string, Zone string, service_zone string")
    dims = trips.dimensions(silver, zones)
    fact = trips.fact(silver, dims).cache()
    assert fact.count() == silver.count()
    for c in ("pickup_date_key", "dropoff_date_key", "vendor_key", "rate_code_key", "store_and_fwd_key", "pickup_location_key", "dropoff_location_key", "payment_type_key", "source_file_key"):
        assert quality.not_null(fact, c).count() == 0, c
    f = {r["source_row_number"]: r for r in rows(fact)}
    assert f[111]["total_tax_and_surcharge_amount"] is None and float(f[100]["total_tax_and_surcharge_amount"]) == 4.75 and float(f[100]["trip_duration_minutes"]) == 20.0
    assert (f[110]["passenger_count_imputed_trip_count"], f[111]["rate_code_unknown_trip_count"], f[112]["airport_fee_missing_trip_count"], f[100]["airport_fee_missing_trip_count"]) == (1, 1, 1, 0)
    assert {r["vendor_key"]: r["vendor_name"] for r in rows(dims["vendor"])}[-1] == "NOT_REPORTED" and {r["payment_type_key"]: r["payment_type_description"] for r in rows(dims["payment_type"])}[77] == "UNRECOGNIZED"
    again = trips.load_silver(silver, silver)
    assert again.count() == silver.count() and trips.months(silver).first().trip_count == silver.count()


# ---- telemetry


def raw_telemetry(spark, records):
    data = [("a.zip", f, n, dt.date(2018, 1, 1), json.dumps(r), dt.datetime(2018, 2, 1)) for f, n, r in records]
    df = spark.createDataFrame(data, "source_archive string, source_file string, source_row long, source_date date, j string, ingested_at timestamp")
    return telemetry.with_record_hash(df.withColumn("raw_record", F.parse_json("j")).drop("j"))


def test_telemetry(spark):
    first = raw_telemetry(spark, [
        ("20180101.csv", 2, {"disk_id": "7", "ds": "20180101", "model": "MC1", "n_5": "1", "r_5": "10.5"}), ("20180101.csv", 3, {"disk_id": "7", "ds": "20180101", "model": "mb2", "n_5": "x", "r_9": "3"}),
        ("20180101.csv", 4, {"disk_id": "8", "ds": "20180101", "model": "MC1", "n_2": "5"}), ("20180101.csv", 5, {"disk_id": "9", "ds": "bad", "model": "mc1", "n_5": "1"}),
    ])
    second = raw_telemetry(spark, [("20180101.csv", 2, {"disk_id": "7", "ds": "20180101", "model": "MC1", "n_5": "1", "r_5": "10.5"}), ("20180101.csv", 4, {"disk_id": "8", "ds": "20180101", "model": "MC1", "n_5": "6"}), ("20180102.csv", 2, {"disk_id": "7", "ds": "20180102", "model": "MC1", "r_5": "11"})])
    bronze = telemetry.load_bronze(first, second)
    assert bronze.count() == 5 and merge.count_missing(second, bronze, ["source_archive", "source_file", "source_row"]).first().missing_rows == 0
    stamps = {r["source_row"]: r["ingested_at"] for r in rows(bronze.where("source_file = '20180101.csv'"))}
    assert stamps[2] == dt.datetime(2018, 2, 1) and stamps[4] > dt.datetime(2020, 1, 1)
    silver = telemetry.silver(bronze).cache()
    assert len(silver.columns) == 8 + 3 + 2 * len(ATTRIBUTE_IDS)
    clean, bad = telemetry.null_policy(telemetry.silver(first), RETAINED_IDS, 2018)
    assert [r["disk_id"] for r in rows(bad)] == [8] and clean.count() == 3 and quality.no_measurement(bad.withColumn("x", F.lit(None)), ["x"]).count() == 0
    good, _ = telemetry.null_policy(silver)
    mc1 = telemetry.of_model(telemetry.all_years(good)).where("observation_date IS NOT NULL")
    labels = telemetry.failure_labels(raw_telemetry(spark, [("labels.csv", 2, {"disk_id": "7", "model": "MC1", "failure_time": "2018-01-20 10:00:00"}), ("labels.csv", 3, {"disk_id": "55", "model": "MC1", "failure_time": "2019-01-20"})]))
    devices = telemetry.dim_device(good, labels)
    assert devices.count() == 5 and telemetry.dim_date(mc1, labels).count() == 385
    daily = telemetry.fact_daily(mc1, devices, MODEL_IDS)
    assert quality.unique(daily, ["smart_daily_key"]).count() == 0 and daily.count() == 3 and len(daily.columns) == 6 + 44
    fact = telemetry.fact_failure(labels, devices)
    assert {r["failure_date_key"] for r in rows(fact)} == {20180120, 20190120}
    assert quality.relationship(fact, "ssd_key", devices, "ssd_key").count() == 0
    built = wide_table.build(daily.withColumnsRenamed({c: c.upper() for c in daily.columns}), fact.select(F.col("ssd_key").alias("SSD_KEY"), F.col("failure_date").alias("FAILURE_DATE")))
    assert {r["LABEL_STATUS"] for r in rows(built.select("LABEL_STATUS"))} == {"POSITIVE", "CENSORED"}


# ---- streaming


def _stream(spark, path, schema, transform, out, state):
    live = transform(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path))
    live.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


def test_stream_episodes_equal_batch(spark, tmp_path):
    rnd = [(f"e{k % 7}", d, ((k * 37 + d * 17) % 100) / 100) for k in range(7) for d in range(60)]
    schema = "e string, d long, s double"
    for part in range(3):  # in day order, a file a period
        spark.createDataFrame([r for r in rnd if part * 20 <= r[1] < part * 20 + 20], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    import os
    import time

    for k, f in enumerate(sorted((p for p in os.listdir(f"{tmp_path}/in") if p.endswith(".parquet")), key=lambda p: spark.read.parquet(f"{tmp_path}/in/{p}").agg(F.min("d")).first()[0])):
        os.utime(f"{tmp_path}/in/{f}", (time.time() - 100 + k * 10,) * 2)
    got = _stream(spark, f"{tmp_path}/in", schema, lambda s: stream.episodes(s, "e", "d", "s", 0.6, 9), f"{tmp_path}/out", f"{tmp_path}/state")
    batch = events.episodes(spark.createDataFrame(rnd, schema).withColumn("days_to_failure", F.lit(None).cast("int")), "e", "d", "s", 0.6, 9)
    assert sorted((r.e, r.opened_day) for r in got.collect()) == sorted((r.e, r.day) for r in batch.collect())


def test_stream_upsert(spark, tmp_path):
    write = stream.upsert_sink(str(tmp_path), ["k"], "h", [F.desc("at")])
    make = lambda x: spark.createDataFrame(x, "k int, v string, h string, at int")
    write(make([(1, "a", "1", 1), (1, "b", "2", 2)]), 0)
    for _ in range(2):  # a repeated micro-batch
        write(make([(1, "c", "3", 3), (2, "d", "4", 3)]), 1)
    assert sorted((r.k, r.v) for r in spark.read.parquet(f"{tmp_path}/v1").collect()) == [(1, "c"), (2, "d")]
