"""Registration of queries with their oracle SQL, and the frames the queries share."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnforge.functions.keys import epoch_day
from tarnforge.functions.lineage import ensure_checkpoint_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared folder that the cluster names."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: The telemetry analogue: one row a user and day; the first error from this day on is the failure.
FAILURE_FROM = "2024-01-15"


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").where("event_type <> 'error'")
    d = F.to_date("ts")
    return e.groupBy("user_id", d.alias("d")).agg(F.round(F.avg("value"), 6).alias("value"), F.count("*").alias("n")).withColumn("day", epoch_day(F.col("d")))


def failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.where(f"event_type = 'error' AND to_date(ts) >= DATE '{FAILURE_FROM}'").select("user_id", F.to_date("ts").alias("failure_date"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily rows with days_to_failure."""
    f = failures(spark, sf_dir).groupBy("user_id").agg(F.min("failure_date").alias("ff"))
    return daily(spark, sf_dir).join(f, "user_id", "left").withColumn("days_to_failure", F.datediff("ff", "d")).drop("ff")


DAILY = """daily AS (
  SELECT user_id, CAST(ts AS DATE) AS d, round(avg(value), 6) AS value, count(*) AS n,
    CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS INTEGER) AS day
  FROM events WHERE event_type <> 'error' GROUP BY user_id, CAST(ts AS DATE)
)"""
FAILED = f"""failed AS (
  SELECT user_id, min(CAST(ts AS DATE)) AS ff, count(*) AS nf FROM events
  WHERE event_type = 'error' AND CAST(ts AS DATE) >= DATE '{FAILURE_FROM}' GROUP BY user_id
)"""
SCORED = f"""{DAILY}, {FAILED}, scored AS (
  SELECT y.*, CAST(date_diff('day', y.d, f.ff) AS INTEGER) AS days_to_failure FROM daily y LEFT JOIN failed f USING (user_id)
)"""


def sparse_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with nulls by fixed rules: the quantity of every fifth line number, the discount of
    returned lines, the tax of small lines."""
    l = read(spark, sf_dir, "lineitem")
    return l.withColumns({
        "l_quantity": F.when(F.col("l_linenumber") % 5 != 0, F.col("l_quantity")), "l_discount": F.when(F.col("l_returnflag") != "R", F.col("l_discount")),
        "l_tax": F.when(F.col("l_quantity") > 10, F.col("l_tax")), "ship_year": F.year("l_shipdate"),
    })


SPARSE = """sparse AS (
  SELECT * REPLACE (CASE WHEN l_linenumber % 5 <> 0 THEN l_quantity END AS l_quantity, CASE WHEN l_returnflag <> 'R' THEN l_discount END AS l_discount,
    CASE WHEN l_quantity > 10 THEN l_tax END AS l_tax), CAST(year(l_shipdate) AS INTEGER) AS ship_year FROM lineitem
)"""
