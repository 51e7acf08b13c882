"""URL filters (native): a sort-merge range join of urls with nested prefix rules.

A rule (host, path prefix) has the canonical key: its host's labels reversed and each
followed by a dot, a slash, which no host has, and the path; ``example.com`` with ``/en/`` is
``com.example.//en/``, and with ``en``, which fits no path of a url, ``com.example./en``. The
keys with that prefix form one interval. A url has one probe for each suffix of its host,
so that a rule for a host fits the host's subdomains too.

Rule starts, rule ends and probes are sorted together once. Intervals of prefixes nest, so
the active rules form a stack: a start pushes its rule, an end pops it and uncovers the
rule beneath, whose identity the end event carries. What a probe needs is the top of the
stack, the longest active rule; it is the last event before the probe. The sweep runs in
each range partition and begins with the state that the partitions before it left. Among
a url's probes the longest rule wins.

Only distinct (host, path) pairs are probed, so that a hot url costs one probe, and the
range partitioning is by key and pair, so that a hot host is split.

Defined cases: a null url, or one without ``://``, has empty host and path and gets the
default verdict; rules with equal keys: the smallest (verdict, rule) stays; a rule with a null host
or path is none, one with an empty path fits all paths; very long urls are whole keys; null ids and
repeated rows stay as they are; no rules or no urls are fine; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnforge.llm.common import cut, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The rules of the registered query: verdict, host, path.
RULES = [
    ("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"), ("block", "org", "/es/"),
]


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(raw) + 1), r"^[^?#]*", 0)
    return F.translate(F.coalesce(raw, F.lit("")), UPPER, LOWER), F.coalesce(path, F.lit(""))


def _key(labels: Column, n: Column, path: Column) -> Column:
    return F.concat(F.array_join(F.slice(labels, F.lit(1), n), "."), F.lit("./"), path)


def _events(rules: DataFrame) -> DataFrame:
    """Start and end events. ``rules``: verdict, host, path."""
    labels = F.reverse(F.split("host", r"\."))
    r = rules.where("host IS NOT NULL AND path IS NOT NULL").select(_key(labels, F.size(labels), F.col("path")).alias("k"), F.struct("verdict", F.concat("host", "path").alias("rule")).alias("top"))
    r = r.groupBy("k").agg(F.min("top").alias("top"))
    over = r.select("k", F.explode_outer(F.when(F.length("k") > 1, F.sequence(F.lit(1), F.length("k") - 1))).alias("n"))
    over = over.select("k", F.substr("k", F.lit(1), "n").alias("up"))
    up = r.select(F.col("k").alias("up"), F.col("top").alias("up_top"))
    parent = over.join(up, "up").groupBy("k").agg(F.max_by("up_top", F.length("up")).alias("below"))
    r = r.join(parent, "k", "left")
    none = F.struct(F.lit(None).cast("string").alias("verdict"), F.lit(None).cast("string").alias("rule"))
    key = F.encode("k", "UTF-8")
    start = r.select(key.alias("key"), F.lit(0).alias("kind"), F.col("top").alias("state"))
    end = r.select(F.concat(key, F.unhex(F.lit("FF"))).alias("key"), F.lit(2).alias("kind"), F.coalesce("below", none).alias("state"))
    return start.unionByName(end)


def sweep_rules(pairs: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct ``(host, path)`` to ``(host, path, rule, verdict)``, of those that a rule fits."""
    labels = F.reverse(F.split("host", r"\."))
    probes = pairs.where(F.col("host") != "").select("host", "path", labels.alias("labels"))
    probes = probes.select("host", "path", "labels", F.explode(F.sequence(F.lit(1), F.size("labels"))).alias("n"))
    probes = probes.select(F.encode(_key(F.col("labels"), F.col("n"), F.col("path")), "UTF-8").alias("key"), F.lit(1).alias("kind"), "host", "path")
    line = probes.unionByName(_events(rules), allowMissingColumns=True)
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    line = cut(line.repartitionByRange(parts, "key", "kind", "host", "path").sortWithinPartitions("key", "kind")).withColumn("part", F.spark_partition_id())
    # The state each partition leaves to the next: as many rows as there are partitions.
    left = line.groupBy("part").agg(F.max_by("state", F.when(F.col("kind") != 1, F.struct("key", "kind"))).alias("leaves"))
    left = left.select("part", F.last("leaves", ignorenulls=True).over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    seen = F.last("state", ignorenulls=True).over(Window.partitionBy("part").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0))
    swept = line.withColumn("seen", seen).where("kind = 1").join(F.broadcast(left), "part")
    top = swept.select("host", "path", F.coalesce("seen", "carried").alias("top")).where("top.rule IS NOT NULL")
    best = top.groupBy("host", "path").agg(F.max_by("top", F.struct(F.length("top.rule"), F.col("top.rule"))).alias("top"))
    return best.select("host", "path", F.col("top.rule").alias("rule"), F.col("top.verdict").alias("verdict"))


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """``(page_id, url)`` to ``(page_id, host, path, rule, verdict)``."""
    host, path = url_parts(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    hits = cut(sweep_rules(urls.select("host", "path").distinct(), rules))
    return urls.join(hits, ["host", "path"], "left").select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def op3_url_rules(spark, sf_dir: str) -> DataFrame:
    values = ", ".join(f"('{verdict}', '{host}', '{path}')" for verdict, host, path in RULES)  # a relation of literals, without Python
    rules = spark.sql(f"SELECT * FROM VALUES {values} AS rules(verdict, host, path)")
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules)


OP3_SQL = """
WITH rules(verdict, host, path) AS (VALUES
  ('block','com','/en/'), ('allow','example.com','/en/7'), ('allow','net','/de/'), ('block','example.net','/de/8'), ('block','org','/es/')
), a AS (
  SELECT page_id, CASE WHEN strpos(coalesce(url,''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), b AS (
  SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM a
), c AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM b
), d AS (
  SELECT c.page_id, c.host, c.path, max(struct_pack(n := length(r.host || r.path), rule := r.host || r.path, verdict := r.verdict)) AS best
  FROM (SELECT *, row_number() OVER () AS id FROM c) c LEFT JOIN rules r
    ON (c.host = r.host OR ends_with(c.host, '.' || r.host)) AND starts_with(c.path, r.path)
  GROUP BY c.id, c.page_id, c.host, c.path
)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict FROM d
"""
