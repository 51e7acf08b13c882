"""Queries of the wide table and the streaming equivalents."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import functions as F

from tarnforge.catalog.analytics import SPAN, TAU, _ONE, _episode_ctes
from tarnforge.catalog.base import DAILY, FAILED, daily, failures, query, read, scratch
from tarnforge.functions.keys import date_key, surrogate_key
from tarnforge.plans import wide_table as w
from tarnforge.sources.ranges import RangeTable, range_sink
from tarnforge.streaming import stateful, stream

SPEC = w.Spec(ids=(1, 5))


def _facts(spark, d, ids):
    """Attributes made of the daily series; the normalised ones are null on busy days."""
    x = daily(spark, d)
    x = x.select(
        surrogate_key(F.col("user_id"), F.date_format("d", "yyyy-MM-dd")).alias("SMART_DAILY_KEY"), F.col("user_id").cast("string").alias("SSD_KEY"), F.col("user_id").alias("DISK_ID"), F.lit("MC1").alias("MODEL_CODE"),
        date_key(F.col("d")).alias("OBSERVATION_DATE_KEY"), F.col("d").alias("OBSERVATION_DATE"),
        *[(F.col("value") * (i % 7 + 1)).cast("decimal(38,6)").alias(f"R_{i}") for i in ids], *[F.when(F.col("n") < 4, F.col("n") + i % 5).cast("decimal(38,6)").alias(f"N_{i}") for i in ids],
    )
    f = failures(spark, d).select(F.col("user_id").cast("string").alias("SSD_KEY"), F.col("failure_date").alias("FAILURE_DATE"))
    return x, f


@query("obt_narrow_spec", f"""WITH {DAILY}, {FAILED}, seen AS (SELECT user_id, max(d) AS last_seen FROM daily GROUP BY 1), x AS (SELECT *, CASE WHEN n < 4 THEN n + 0.0 END AS n5 FROM daily), r AS (SELECT user_id, d, day, avg(n5) OVER c AS m, count(n5) OVER c AS k, avg(n5) OVER p AS pm, count(n5) OVER p AS pk FROM x
WINDOW c AS (PARTITION BY user_id ORDER BY day RANGE BETWEEN 13 PRECEDING AND CURRENT ROW), p AS (PARTITION BY user_id ORDER BY day RANGE BETWEEN 27 PRECEDING AND 14 PRECEDING))
SELECT CAST(r.user_id AS VARCHAR) AS SSD_KEY, r.d AS OBSERVATION_DATE, round(m::DOUBLE, 4) AS N_5_MEAN_14D, k AS N_5_COUNT_14D, pk AS N_5_PREV_COUNT_14D, round((CASE WHEN k > 0 AND pk > 0 THEN m - pm END)::DOUBLE, 4) AS N_5_MEAN_SHIFT_14D, (k > 0 AND pk > 0)::INT AS N_5_MEAN_SHIFT_VALID_14D,
  CASE WHEN r.d > f.ff THEN 'POST_FAILURE' WHEN r.d = f.ff THEN 'SAME_DAY_FAILURE' WHEN date_diff('day', r.d, f.ff) BETWEEN 1 AND 30 THEN 'POSITIVE' WHEN date_diff('day', r.d, s.last_seen) >= 30 THEN 'NEGATIVE' ELSE 'CENSORED' END AS LABEL_STATUS
FROM r LEFT JOIN failed f USING (user_id) LEFT JOIN seen s USING (user_id)""")
def obt_narrow(spark, d):
    out = w.build(*_facts(spark, d, SPEC.ids), SPEC)
    r = lambda c: F.round(F.col(c).cast("double"), 4).alias(c)
    return out.select("SSD_KEY", "OBSERVATION_DATE", r("N_5_MEAN_14D"), "N_5_COUNT_14D", "N_5_PREV_COUNT_14D", r("N_5_MEAN_SHIFT_14D"), "N_5_MEAN_SHIFT_VALID_14D", "LABEL_STATUS")


@query("obt_wide_status", f"""WITH {DAILY}, {FAILED}, seen AS (SELECT user_id, max(d) AS last_seen FROM daily GROUP BY 1)
SELECT CASE WHEN r.d > f.ff THEN 'POST_FAILURE' WHEN r.d = f.ff THEN 'SAME_DAY_FAILURE' WHEN date_diff('day', r.d, f.ff) BETWEEN 1 AND 30 THEN 'POSITIVE' WHEN date_diff('day', r.d, s.last_seen) >= 30 THEN 'NEGATIVE' ELSE 'CENSORED' END AS LABEL_STATUS, count(*) AS row_count, 847 AS width
FROM daily r LEFT JOIN failed f USING (user_id) LEFT JOIN seen s USING (user_id) GROUP BY 1""")
def obt_wide(spark, d):
    """The 847-column table, stored and counted from what was stored."""
    spec = w.Spec()
    stage = scratch(spark, "obt")
    w.build(*_facts(spark, d, spec.ids), spec).write.parquet(stage)
    out = spark.read.parquet(stage)
    return out.groupBy("LABEL_STATUS").agg(F.count("*").alias("row_count"), F.lit(len(out.columns)).alias("width"))


def _stream(spark, path: str, schema, **options):
    """A folder or one file of Parquet as a stream."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").options(**options)
    return reader.parquet(path if _is_folder(spark, path) else f"{path[:-1]}[{path[-1]}]")


def _events(spark, d):
    path = f"{d}/events.parquet"
    return _stream(spark, path, spark.read.parquet(path).schema).withColumn("ts", F.col("ts").cast("timestamp"))


def _ended(spark, out):
    """All that a stream gives by its end, as a table."""
    folder = scratch(spark, "stream")
    out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out")


@query("st_stream_latest_once", "SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY 1")
def st_latest(spark, d):
    """The events as a stream, each delivered twice, de-duplicated within the watermark."""
    live = _events(spark, d)
    return _ended(spark, stream.latest_once(live.unionByName(live), ["event_id"], "ts", "30 days")).groupBy("event_type").agg(F.count("*").alias("n"))


@query("st_windowed_means", """WITH w AS (SELECT event_type, value, date_trunc('day', ts) - to_days(CAST(i AS INTEGER)) AS a FROM events, range(7) t(i))
SELECT event_type, CAST(a AS DATE) AS first_day, round(avg(value), 6) AS mean_value, count(value) AS n_values FROM w WHERE a + INTERVAL 7 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY GROUP BY 1, 2""")
def st_means(spark, d):
    """Sliding means of all windows that the watermark has closed."""
    out = _ended(spark, stream.windowed_means(_events(spark, d), "event_type", "ts", "value"))
    return out.select("event_type", F.to_date("window_start").alias("first_day"), F.round("mean_value", 6).alias("mean_value"), "n_values")


@query("st_late_rows", "SELECT CAST(ts + to_days(CAST(event_id % 4 AS INTEGER)) AS DATE) AS day, count(*) AS row_count, count(*) FILTER (WHERE event_id % 4 > 2) AS late_rows FROM events GROUP BY 1")
def st_late(spark, d):
    """Rows that arrive later than two days, counted by a stream as a whole."""
    live = _events(spark, d).withColumn("arrived", F.col("ts") + F.make_dt_interval((F.col("event_id") % 4).cast("int")))
    name = f"late_{uuid.uuid4().hex}"
    stream.late_rows(live, "ts", "arrived", "2 days").writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", scratch(spark, "stream")).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


@query("st_episodes", f"WITH RECURSIVE {_episode_ctes(_ONE)} SELECT user_id, CAST(day AS BIGINT) AS opened_day FROM opened")
def st_episodes(spark, d):
    """The episode state machine over a stream of daily scores."""
    path = scratch(spark, "daily")
    daily(spark, d).select("user_id", "day", "value").write.parquet(path)
    return _ended(spark, stream.episodes(_stream(spark, path, "user_id long, day int, value double"), "user_id", "day", "value", TAU, SPAN))


@query("st_micro_batch_upsert", """WITH t AS (SELECT p_partkey, p_name, p_size FROM part WHERE p_size > 10), s AS (SELECT p_partkey, CASE WHEN p_size > 25 THEN upper(p_name) ELSE p_name END AS p_name, p_size FROM part WHERE p_size <= 40)
SELECT p_partkey, coalesce(s.p_name, t.p_name) AS p_name FROM t FULL JOIN s USING (p_partkey)""")
def st_upsert(spark, d):
    """Two deliveries, a micro-batch each, merged into versions of a table."""
    folder, p = scratch(spark, "upsert"), read(spark, d, "part")
    first, second = p.where("p_size > 10"), p.where("p_size <= 40").withColumn("p_name", F.when(F.col("p_size") > 25, F.upper("p_name")).otherwise(F.col("p_name")))
    for n, rows in enumerate((first, second)):
        rows.select("p_partkey", "p_name", "p_size", surrogate_key(F.col("p_name"), F.col("p_size")).alias("row_hash"), F.lit(n).alias("stamp")).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        time.sleep(1.1)  # files are taken in the order of their times
    live = _stream(spark, f"{folder}/in", spark.read.parquet(f"{folder}/in").schema, maxFilesPerTrigger="1")
    sink = stream.upsert_sink(f"{folder}/table", ["p_partkey"], "row_hash", [F.desc("stamp")])
    live.writeStream.foreachBatch(sink).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return stream.latest_version(spark, f"{folder}/table").select("p_partkey", "p_name")


def _far(spark, schema, folder, **more):
    """A row far ahead of all others, as a table of a folder, so that a stream that ends closes all that it holds."""
    path = f"{folder}/far-{uuid.uuid4().hex}"
    stateful.sentinel(spark, schema, {"ts": stateful.FAR, "user_id": -1, **more}).write.parquet(path)
    return path


@query("st_sessions", """WITH e AS (SELECT user_id, ts, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events), s AS (SELECT user_id, ts, count(*) FILTER (WHERE gap IS NULL OR gap >= INTERVAL 6 HOUR) OVER (PARTITION BY user_id ORDER BY ts, gap DESC NULLS LAST ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, n_events, count(*) AS n_sessions, max(hours) AS longest_hours FROM (SELECT user_id, k, count(*) AS n_events, round(epoch(max(ts) - min(ts)) / 3600.0, 4) AS hours FROM s GROUP BY 1, 2) GROUP BY 1, 2""")
def st_sessions(spark, d):
    """Sessions of users with gaps under six hours, all closed by a last row far ahead."""
    folder, path = scratch(spark, "sessions"), f"{d}/events.parquet"
    schema = spark.read.parquet(path).select("user_id", F.col("ts").cast("timestamp").alias("ts")).schema
    live = _events(spark, d).select("user_id", "ts").unionByName(_stream(spark, _far(spark, schema, folder), schema))
    out = _ended(spark, stateful.sessions(live, "user_id", "ts", "6 hours", "1 day")).where("user_id <> -1")
    hours = F.round((F.unix_micros("last_at") - F.unix_micros("first_at")) / 3.6e9, 4)
    return out.groupBy("user_id", "n_events").agg(F.count("*").alias("n_sessions"), F.max(hours).alias("longest_hours"))


@query("st_episodes_with_timers", f"WITH RECURSIVE {_episode_ctes(_ONE)} SELECT user_id, CAST(day AS BIGINT) AS opened_day FROM opened")
def st_episodes_timers(spark, d):
    """The episodes again, of alerts in any order, with state that ends."""
    folder = scratch(spark, "daily")
    rows = daily(spark, d).select("user_id", F.col("d").cast("timestamp").alias("ts"), "value")
    rows.write.parquet(f"{folder}/in")
    live = _stream(spark, f"{folder}/in", rows.schema).unionByName(_stream(spark, _far(spark, rows.schema, folder, value=1e9), rows.schema))
    return _ended(spark, stateful.episodes(live, "user_id", "ts", "value", TAU, "400 days", SPAN)).where("user_id <> -1")


@query("st_late_labels", """WITH t AS (SELECT DISTINCT user_id, ts FROM events WHERE event_type = 'purchase'), f AS (SELECT user_id AS u, ts AS failed FROM events WHERE event_type = 'error')
SELECT t.user_id, count(*) AS row_count, count(days) AS labelled, sum(days)::BIGINT AS days FROM (SELECT t.user_id, t.ts, min(date_diff('day', CAST(t.ts AS DATE), CAST(failed AS DATE))) AS days FROM t LEFT JOIN f ON f.u = t.user_id AND failed >= t.ts AND CAST(failed AS DATE) - CAST(t.ts AS DATE) <= 10 GROUP BY 1, 2) t GROUP BY 1""")
def st_late_labels(spark, d):
    """Purchases labelled by the first error in the ten days that follow, which comes on a stream of its own."""
    folder, path = scratch(spark, "labels"), f"{d}/events.parquet"
    rows = spark.read.parquet(path).select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    far = lambda: _stream(spark, _far(spark, rows.schema, folder), rows.schema)
    bought = _events(spark, d).where("event_type = 'purchase'").select("user_id", "ts").unionByName(far())
    failed = _events(spark, d).where("event_type = 'error'").select("user_id", "ts").unionByName(far()).withColumnRenamed("ts", "failed")
    out = _ended(spark, stateful.late_labels(bought, failed, "user_id", "ts", "failed", "400 days", 10)).where("user_id <> -1")
    return out.groupBy("user_id").agg(F.count("*").alias("row_count"), F.count("days_to_failure").alias("labelled"), F.sum(F.col("days_to_failure").cast("long")).alias("days"))


@query("m1_merge_by_ranges", """WITH s AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderdate < TIMESTAMP '1993-01-01' AND o_orderkey % 3 > 0), t AS (SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 11 > 0)
SELECT o_orderkey, coalesce(s.o_totalprice, t.o_totalprice) AS o_totalprice FROM t FULL JOIN s USING (o_orderkey)""")
def m1_ranges(spark, d):
    """A table of orders in ranges of dates, into which a batch of the first year is merged, whole."""
    return _merged_orders(spark, d).read().select("o_orderkey", "o_totalprice")


@query("m1_untouched_ranges", "SELECT 12 AS ranges, count(*) AS row_count, true AS untouched_keep_files, true AS others_keep_base FROM orders WHERE o_orderkey % 11 > 0 OR (o_orderdate < TIMESTAMP '1993-01-01' AND o_orderkey % 3 > 0)")
def m1_untouched(spark, d):
    """The same merge: ranges behind the batch's last day keep all their files, the others their base files."""
    t = _merged_orders(spark, d)
    before, after = t.manifest(0)["ranges"], t.manifest()["ranges"]
    untouched = all(a == b for a, b in zip(before, after) if a["low"] and a["low"] >= "1993-01-01")
    return t.read().agg(F.lit(len(after)).alias("ranges"), F.count("*").alias("row_count"), F.lit(untouched).alias("untouched_keep_files"), F.lit(all(a["base"] == b["base"] for a, b in zip(before, after))).alias("others_keep_base"))


def _merged_orders(spark, d):
    o = read(spark, d, "orders").select(F.to_date("o_orderdate").alias("day"), "o_orderkey", "o_totalprice").withColumn("row_hash", surrogate_key(F.col("o_totalprice").cast("string")))
    base = o.where("o_orderkey % 11 > 0")
    t = RangeTable(spark, scratch(spark, "ranges"), ["day", "o_orderkey"], range_rows=-(-base.count() // 12))
    t.create(base)
    batch = o.where("day < DATE '1993-01-01' AND o_orderkey % 3 > 0").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 5 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    t.merge(batch.withColumn("row_hash", surrogate_key(F.col("o_totalprice").cast("string"))), [F.desc("o_totalprice")], "row_hash")
    return t


@query("st_upsert_by_ranges", """WITH t AS (SELECT p_partkey, p_name, p_size FROM part WHERE p_size > 10), s AS (SELECT p_partkey, CASE WHEN p_size > 25 THEN upper(p_name) ELSE p_name END AS p_name, p_size FROM part WHERE p_size <= 40)
SELECT p_partkey, coalesce(s.p_name, t.p_name) AS p_name FROM t FULL JOIN s USING (p_partkey)""")
def st_upsert_ranges(spark, d):
    """Two deliveries, a micro-batch each, merged into a table of ranges, whose ranges of two merges are rewritten."""
    folder, p = scratch(spark, "upsert"), read(spark, d, "part")
    first, second = p.where("p_size > 10"), p.where("p_size <= 40").withColumn("p_name", F.when(F.col("p_size") > 25, F.upper("p_name")).otherwise(F.col("p_name")))
    for n, rows in enumerate((first, second)):
        rows.select("p_partkey", "p_name", "p_size", surrogate_key(F.col("p_name"), F.col("p_size")).alias("row_hash"), F.lit(n).alias("stamp")).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        time.sleep(1.1)  # files are taken in the order of their times
    live = _stream(spark, f"{folder}/in", spark.read.parquet(f"{folder}/in").schema, maxFilesPerTrigger="1")
    table = RangeTable(spark, f"{folder}/table", ["p_partkey"], range_rows=max(1, first.count() // 4))
    live.writeStream.foreachBatch(range_sink(table, [F.desc("stamp")], "row_hash", 1)).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return table.read().select("p_partkey", "p_name")


def _is_folder(spark, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()
