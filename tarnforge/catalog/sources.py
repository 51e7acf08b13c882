"""Queries of readers, snapshots, stages and publication: each writes to the shared folder and reads back."""

from __future__ import annotations

import io

from pyspark.sql import functions as F

from tarnforge.catalog.base import SPARSE, query, read, scratch, sparse_lines
from tarnforge.functions.lineage import cut
from tarnforge.operators import clean, quality
from tarnforge.sources import archives, bronze, publish, snapshot, tables

_NATION = "SELECT n_nationkey, n_name, n_regionkey, row_number() OVER (ORDER BY n_nationkey) AS place FROM nation"


def _orders(spark, d):
    return read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", F.to_date("o_orderdate").alias("day"))


@query("s4_csv_with_lineage", f"SELECT 'a.zip' AS source_archive, place + 1 AS source_row, CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name FROM ({_NATION})")
def s4(spark, d):
    """One CSV file of nations in order, read with its line numbers."""
    path = scratch(spark, "csv")
    read(spark, d, "nation").select("n_nationkey", "n_name").orderBy("n_nationkey").coalesce(1).write.option("header", True).csv(path)
    out = bronze.read_csv(spark, path, ["n_nationkey", "n_name"], "a.zip")
    return out.select("source_archive", "source_row", "n_nationkey", "n_name")


_DAY = "strftime(o_orderdate, '%Y%m%d')"


@query("s2_zip_members", f"SELECT year(o_orderdate) || '.zip' AS source_archive, 'x/' || {_DAY} || '.csv' AS source_file, row_number() OVER (PARTITION BY {_DAY} ORDER BY o_orderkey) + 1 AS source_row, {_DAY} AS source_date, CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderstatus, o_orderpriority FROM orders")
def s2(spark, d):
    """Orders as archives of years with a CSV member a day, written and read by executors."""
    path, o = scratch(spark, "zip"), read(spark, d, "orders")
    day = F.date_format("o_orderdate", "yyyyMMdd")
    rows = o.select(F.year("o_orderdate").cast("string").alias("archive"), F.concat(F.lit("x/"), day, F.lit(".csv")).alias("member"), "o_orderkey", "o_orderstatus", "o_orderpriority")
    archives.write_members(rows, path, "archive", "member", ["o_orderkey"])
    return archives.member_rows(spark, path, ["o_orderkey", "o_orderstatus", "o_orderpriority"])


@query("s2_members_of_days", f"SELECT {_DAY} AS source_date, count(*) AS n, CAST(max(o_orderkey) AS VARCHAR) AS last_key FROM orders WHERE CAST(o_orderdate AS DATE) IN (DATE '1996-02-29', DATE '1997-01-01') GROUP BY 1")
def s2_days(spark, d):
    """Of the archives only the members of two days are opened."""
    path, o = scratch(spark, "zip"), read(spark, d, "orders").where("year(o_orderdate) IN (1996, 1997)")
    day = F.date_format("o_orderdate", "yyyyMMdd")
    archives.write_members(o.select(F.year("o_orderdate").cast("string").alias("archive"), F.concat(day, F.lit(".csv")).alias("member"), "o_orderkey"), path, "archive", "member", ["o_orderkey"])
    got = archives.member_rows(spark, path, ["o_orderkey"], days=["1996-02-29", "1997-01-01"])
    return got.groupBy("source_date").agg(F.count("*").alias("n"), F.max(F.col("o_orderkey").cast("long")).cast("string").alias("last_key"))


def _cut_off_at_first(source: str, attempt: int):
    """Half of a file at the first attempt, all of it then."""
    system, at = archives.file_system(source)
    with system.open_input_file(at) as f:
        content = f.read()
    return io.BytesIO(content[: len(content) // 2] if attempt == 0 else content)


@query("s6_fetched_file", "SELECT s_suppkey, s_name, true AS whole FROM supplier")
def s6(spark, d):
    """Files that arrive cut off at first and whole at the second attempt, copied by executors; their hashes are those of the sources."""
    path = scratch(spark, "source")
    read(spark, d, "supplier").select("s_suppkey", "s_name").write.parquet(path)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
    got = cut(archives.copy_whole(files.select(F.col("path").alias("source")), f"{path}-copy", pause=0, opener=_cut_off_at_first))
    same = got.join(files.select(F.col("path").alias("source"), F.sha2("content", 256).alias("want")), "source").agg((F.count_if(F.col("sha256") == F.col("want")) == F.count("*")).alias("whole"))
    return spark.read.parquet(f"{path}-copy").crossJoin(F.broadcast(same))  # one row


@query("s19_footer_nulls", f"WITH {SPARSE} SELECT 'l_tax' AS column_name, count(*) AS row_count, count(*) FILTER (WHERE l_tax IS NULL) AS null_count FROM sparse UNION ALL SELECT 'l_discount', count(*), count(*) FILTER (WHERE l_discount IS NULL) FROM sparse UNION ALL SELECT 'l_partkey', count(*), 0 FROM sparse")
def s19(spark, d):
    """Nulls from the footers of files, read by executors, without reading a column."""
    path = scratch(spark, "footers")
    sparse_lines(spark, d).select("l_tax", "l_discount", "l_partkey").write.parquet(path)
    return archives.footer_nulls(spark, path, ["l_tax", "l_discount", "l_partkey"])


@query("s19_footer_ranges", "SELECT 'o_orderkey' AS column_name, count(*) AS row_count, CAST(min(o_orderkey) AS VARCHAR) AS low, CAST(max(o_orderkey) AS VARCHAR) AS high FROM orders")
def s19_ranges(spark, d):
    """Rows, least and largest key of a snapshot from its footers alone."""
    path = scratch(spark, "footers")
    read(spark, d, "orders").select("o_orderkey", "o_totalprice").write.parquet(path)
    g = archives.footer_stats(spark, path).where("column_name = 'o_orderkey'").groupBy("column_name")
    return g.agg(F.sum("row_count").alias("row_count"), F.min(F.col("low").cast("long")).cast("string").alias("low"), F.max(F.col("high").cast("long")).cast("string").alias("high"))


@query("s3_load_plan", "WITH m AS (SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS m FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01'), r AS (SELECT m, (row_number() OVER (ORDER BY m) - 1) // 2 AS g FROM m) SELECT min(m) || '..' || max(m) AS id, (SELECT count(DISTINCT CAST(o_orderdate AS DATE)) FROM orders WHERE strftime(o_orderdate, '%Y-%m') BETWEEN min(m) AND max(m)) AS n_days FROM r GROUP BY g")
def s3(spark, d):
    """Days of a year in at most six loads of whole months."""
    days = [str(r.day) for r in _orders(spark, d).select("day").distinct().collect()]
    return spark.createDataFrame([(p["id"], len(p["dates"])) for p in bronze.plan_loads(days, "1996-01-01", "1996-12-31")], "id string, n_days long")


@query("s5_parquet_records", "SELECT '2025-01' AS source_month, row_number() OVER () AS source_row_number, n_name, n_regionkey FROM nation")
def s5(spark, d):
    """Raw records of a file with row numbers, and fields read from them again."""
    r = bronze.read_parquet(spark, f"{d}/nation.parquet", "2025-01")
    return r.select("source_month", "source_row_number", F.variant_get("raw_record", "$.n_name", "string").alias("n_name"), F.variant_get("raw_record", "$.n_regionkey", "int").alias("n_regionkey"))


@query("s8_upload_stage", "SELECT n_nationkey, n_name, false AS left_after FROM nation")
def s8(spark, d):
    """A compressed upload, read back, then cleared."""
    root = scratch(spark, "upload")
    path = tables.put_stage(read(spark, d, "nation").select("n_nationkey", "n_name"), root, "0123456789abcdef", "nation")
    rows = cut(spark.read.csv(path, header=True, schema="n_nationkey int, n_name string"))
    tables.clear_stage(spark, root, "0123456789abcdef")
    return rows.withColumn("left_after", F.lit(tables.clear_stage(spark, root, "0123456789abcdef")))


@query("s9_table_scan", "SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1")
def s9(spark, d):
    read(spark, d, "supplier").createOrReplaceTempView("_supplier")
    return tables.scan(spark, "_supplier").groupBy("s_nationkey").agg(F.count("*").alias("n"))


_CONNECTOR = "SELECT l_suppkey, sum(l_quantity) AS quantity FROM {lineitem} JOIN {orders} ON o_orderkey = l_orderkey WHERE o_orderdate >= TIMESTAMP '1998-01-01' AND l_returnflag = 'N' GROUP BY 1"


@query("s10_connector_query", _CONNECTOR.format(lineitem="lineitem", orders="orders"))
def s10(spark, d):
    return tables.Connector(spark, d, ".parquet").query(_CONNECTOR, ["lineitem", "orders"])


@query("s10_connector_table", "SELECT s_suppkey, s_name FROM supplier")
def s10_table(spark, d):
    return tables.Connector(spark, d, ".parquet").table("supplier", ["s_suppkey", "s_name"])


@query("s12_seed", "SELECT r_regionkey, r_name FROM region")
def s12(spark, d):
    path = scratch(spark, "seed")
    read(spark, d, "region").select("r_regionkey", "r_name").coalesce(1).write.option("header", True).option("quoteAll", True).csv(path)
    return bronze.read_seed(spark, path, "r_regionkey int, r_name string")


def _snapshot(spark, d):
    path = scratch(spark, "snapshot")
    o = _orders(spark, d).withColumn("y", F.when(F.col("o_orderstatus") == "F", 1).otherwise(0))
    snapshot.export(o, path, "day")
    snapshot.write_manifest(spark, path, snapshot.manifest(spark, path, "o_custkey", "day", "y", "select 1"))
    return path


@query("s14_pruned_scan", "SELECT o_orderkey, CAST(o_totalprice AS FLOAT) AS price FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1997-01-01' AND DATE '1997-03-31'")
def s14(spark, d):
    """Columns and days of a snapshot, whose hash is verified first."""
    out = snapshot.load(spark, _snapshot(spark, d), ["o_orderkey", "o_totalprice"], "day", "o_orderkey", "1997-01-01", "1997-03-31")
    return out.select("o_orderkey", snapshot.float_columns(["o_totalprice"])[0].alias("price"))


@query("s15_snapshot_by_month", "SELECT strftime(o_orderdate, '%Y-%m') AS mes, count(*) AS n, min(CAST(o_orderdate AS DATE)) AS first_day, max(CAST(o_orderdate AS DATE)) AS last_day FROM orders GROUP BY 1")
def s15(spark, d):
    """Export by month, read back with the month of the directory."""
    out = spark.read.parquet(_snapshot(spark, d))
    return out.groupBy(F.col("mes").cast("string").alias("mes")).agg(F.count("*").alias("n"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))


@query("s16_reconciled_rows", "SELECT count(*) AS n, true AS one_more_is_an_error FROM orders")
def s16(spark, d):
    path = _snapshot(spark, d)
    n = _orders(spark, d).count()
    snapshot.reconcile_rows(spark, path, n)
    try:
        snapshot.reconcile_rows(spark, path, n + 1)
        error = False
    except snapshot.SnapshotError:
        error = True
    return spark.createDataFrame([(n, error)], "n long, one_more_is_an_error boolean")


@query("s17_manifest", "SELECT count(*) AS row_count, CAST(min(CAST(o_orderdate AS DATE)) AS VARCHAR) AS first_day, CAST(max(CAST(o_orderdate AS DATE)) AS VARCHAR) AS last_day, count(*) FILTER (WHERE o_orderstatus = 'F') AS positives, count(DISTINCT o_custkey) AS entities, sha256('select 1') AS sql_sha256, true AS hash_of_its_files FROM orders")
def s17(spark, d):
    """The manifest's figures; its hash is compared with one that Spark makes of the files' hashes."""
    path = _snapshot(spark, d)
    m, files = snapshot.read_manifest(spark, path), snapshot.file_hashes(spark, path)
    lines = F.array_join(F.sort_array(F.collect_list(F.concat_ws(" ", "file", "sha256"))), "\n")  # a line a file
    row = (m["rows"], m["first"], m["last"], m["positives"], m["entities"], m["sql_sha256"])
    out = spark.createDataFrame([row], "row_count long, first_day string, last_day string, positives long, entities long, sql_sha256 string")
    return out.crossJoin(files.agg((F.sha2(lines, 256) == F.lit(m["dataset_sha256"])).alias("hash_of_its_files")))


@query("s18_file_hashes", "SELECT strftime(o_orderdate, '%Y-%m') AS mes, 1 AS n_files, true AS changed_with_content, true AS same_again FROM orders GROUP BY 1")
def s18(spark, d):
    """A month is one file here. The same rows give the same hash of the content again, other rows give each month another one."""
    first, again, other = (scratch(spark, "hashes") for _ in range(3))
    o = _orders(spark, d)
    for path, rows in ((first, o), (again, o), (other, o.withColumn("o_totalprice", F.col("o_totalprice") + 1))):
        snapshot.export(rows, path, "day")
    month = F.regexp_extract("file", "mes=([^/]+)", 1).alias("mes")
    h, a, b = (snapshot.file_hashes(spark, p).select(month, F.col("content_sha256").alias(n)) for p, n in ((first, "h"), (again, "a"), (other, "b")))
    g = h.join(a, "mes").join(b, "mes").groupBy("mes")
    return g.agg(F.count("*").cast("int").alias("n_files"), F.bool_and(F.col("h") != F.col("b")).alias("changed_with_content"), F.bool_and(F.col("h") == F.col("a")).alias("same_again"))


@query("s20_cache_slice", "SELECT o_orderkey, CAST(o_totalprice AS FLOAT) AS o_totalprice FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1996-02-10' AND DATE '1996-02-20'")
def s20(spark, d):
    """A contiguous date slice of a model cache."""
    path = scratch(spark, "cache")
    snapshot.model_cache(_orders(spark, d), path, ["o_totalprice"], ["o_orderkey", "day"], "day")
    return snapshot.load_slice(spark, path, "day", "1996-02-10", "1996-02-20", ["o_orderkey", "o_totalprice"])


@query("s20_month_at_a_time", "SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(*) AS n FROM orders WHERE year(o_orderdate) = 1997 GROUP BY 1")
def s20_months(spark, d):
    path = scratch(spark, "cache")
    snapshot.model_cache(_orders(spark, d).where("year(day) = 1997"), path, ["o_totalprice"], ["day"], "day")
    return spark.createDataFrame([(m, rows.count()) for m, rows in snapshot.months_of(spark, path, "day")], "month date, n long")


_PUBLISHED = "SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_acctbal > 0 GROUP BY 1"


@query("s23_published_table", _PUBLISHED)
def s23(spark, d):
    """Three stages, of which the second one is promoted last and the first one is dropped."""
    root, c = scratch(spark, "publish"), read(spark, d, "customer")
    paths = [publish.stage_path(root, "customers", publish.run_id(n)) for n in "abc"]
    for p, rows in zip(paths, (c, c.where("c_acctbal > 0"), c.limit(1))):
        publish.write_stage(rows, p)
    for p in paths[:2]:
        publish.promote(spark, p, "_customers", root, "customers")
    publish.drop_stages(spark, [paths[0]], True)
    return spark.table("_customers").groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@query("q_tests_inside_the_write", """SELECT o_orderkey, CASE WHEN o_orderdate >= TIMESTAMP '1998-01-01' THEN 2 ELSE 0 END + CASE WHEN o_totalprice < 2000 THEN 1 ELSE 0 END AS flags,
count(*) OVER () AS row_count, count(*) FILTER (WHERE o_totalprice < 2000) OVER () AS cheap, count(*) FILTER (WHERE o_orderdate >= TIMESTAMP '1998-01-01') OVER () AS late, true AS stays FROM orders WHERE o_orderstatus <> 'P'""")
def q_inside(spark, d):
    """A stage whose tests are taken in the pass that writes it. It fails them, and stays with its flags, from which alone the counts are read."""
    path, o = publish.stage_path(scratch(spark, "tested"), "orders", "r"), read(spark, d, "orders").where("o_orderstatus <> 'P'")
    tests = {"cheap": F.col("o_totalprice") < 2000, "late": F.col("o_orderdate") >= F.lit("1998-01-01")}
    try:
        publish.write_tested(o, path, tests)
        stays = False
    except ValueError:
        stays = True
    stored = spark.read.parquet(path)
    c = quality.flag_counts(stored, list(tests))
    return stored.select("o_orderkey", F.col(quality.FLAGS).cast("int").alias("flags"), *[F.lit(v).cast("long").alias(n) for n, v in c.items()], F.lit(stays).alias("stays"))


@query("m8_full_rebuild", _PUBLISHED)
def m8(spark, d):
    """A table built twice: readers get the second build."""
    root, c = scratch(spark, "rebuild"), read(spark, d, "customer")
    publish.rebuild(c, root, "customers", "_rebuilt", "a")
    return publish.rebuild(c.where("c_acctbal > 0"), root, "customers", "_rebuilt", "b").groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@query("s22_audit_rows", """SELECT r_name AS run_id, CASE WHEN n > 4 THEN 'published' ELSE 'failed' END AS status, CASE WHEN n > 4 THEN n::INTEGER END AS output_rows, CASE WHEN n <= 4 THEN 'token=*** is bad' END AS error
FROM (SELECT r_name, count(n_nationkey) FILTER (WHERE n_nationkey % 7 <> 3) AS n FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY 1)""")
def s22(spark, d):
    """A run a region: it is published with its nations, or fails where they are few, with its secret masked."""
    path = scratch(spark, "audit")
    n = read(spark, d, "nation").where("n_nationkey % 7 <> 3")
    runs = read(spark, d, "region").join(n, F.col("n_regionkey") == F.col("r_regionkey"), "left").groupBy("r_name").agg(F.count("n_nationkey").alias("n"))
    for r in runs.collect():  # a row a region
        if r.n > 4:
            publish.audit(spark, path, r.r_name, "published", {"output_rows": r.n})
        else:
            publish.audit(spark, path, r.r_name, "failed", {}, "token=abc is bad")
    return spark.read.parquet(path).select("run_id", "status", F.col("output_rows").cast("int").alias("output_rows"), "error")


@query("s24_dropped_stages", "SELECT r_name, n_nationkey, n_name, CASE WHEN r_regionkey % 2 = 0 THEN 0 ELSE 1 END AS dropped FROM region JOIN nation ON n_regionkey = r_regionkey WHERE r_regionkey % 2 = 0")
def s24(spark, d):
    """A stage a region. Those of failed runs (even regions) stay for inspection with all their rows, the others are dropped."""
    root, parts = scratch(spark, "stages"), []
    n = read(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    for r in read(spark, d, "region").select("r_regionkey", "r_name").collect():  # a row a region
        path = publish.stage_path(root, f"nations{r.r_regionkey}", "r")
        publish.write_stage(n.where(F.col("n_regionkey") == r.r_regionkey).drop("n_regionkey"), path)
        dropped = publish.drop_stages(spark, [path], r.r_regionkey % 2 == 1)
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            parts.append(spark.read.parquet(path).select(F.lit(r.r_name).alias("r_name"), "n_nationkey", "n_name", F.lit(dropped).alias("dropped")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("s25_small_export", "SELECT r_regionkey, r_name, true AS larger_is_an_error FROM region")
def s25(spark, d):
    path, r = scratch(spark, "export"), read(spark, d, "region").select("r_regionkey", "r_name")
    snapshot.export_csv(r, path, 5)
    try:
        snapshot.export_csv(r, f"{path}-more", 4)
        error = False
    except snapshot.SnapshotError:
        error = True
    return spark.read.csv(path, header=True, schema="r_regionkey int, r_name string").withColumn("larger_is_an_error", F.lit(error))


@query("s26_frozen_sample", "SELECT count(*) AS n, true AS hash_of_its_files FROM customer WHERE c_acctbal > 0")
def s26(spark, d):
    """Frozen once: another request gets the first rows, whose hash is that of the files."""
    path, c = scratch(spark, "frozen"), read(spark, d, "customer")
    snapshot.freeze(c.where("c_acctbal > 0"), path)
    lines = F.array_join(F.sort_array(F.collect_list(F.concat_ws(" ", "file", "sha256"))), "\n")  # a line a file
    same = snapshot.file_hashes(spark, path).agg((F.sha2(lines, 256) == F.lit(snapshot.read_manifest(spark, path)["dataset_sha256"])).alias("hash_of_its_files"))
    return snapshot.freeze(c, path).agg(F.count("*").alias("n")).crossJoin(same)


@query("session_context", "SELECT 'spark_catalog' AS catalog, 'default' AS schema, n_regionkey, count(*) AS n FROM nation GROUP BY 3")
def session_context(spark, d):
    """A table by its name in the session's catalog and schema."""
    s = tables.session(spark).select("catalog", "schema")
    read(spark, d, "nation").createOrReplaceTempView("_nation")
    return tables.scan(spark, "_nation").groupBy("n_regionkey").agg(F.count("*").alias("n")).crossJoin(F.broadcast(s))  # one row


@query("p4_aliased_columns", "SELECT n_nationkey, n_name FROM nation")
def p4(spark, d):
    return read(spark, d, "nation").alias("n").select(*clean.aliased("n", ["n_nationkey", "n_name"]))


@query("p19_record_hash", "SELECT n_nationkey, sha256('{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\"}') AS source_sha256 FROM nation")
def p19(spark, d):
    """The hash of each raw record's JSON."""
    n = read(spark, d, "nation").select("n_nationkey", F.struct("n_nationkey", "n_name").alias("raw_record"))
    from tarnforge.plans import telemetry

    return telemetry.with_record_hash(n).select("n_nationkey", "source_sha256")


@query("q14_columns_absent", "SELECT * FROM (VALUES ('C_NAME'), ('C_PHONE')) AS t(forbidden) WHERE forbidden IN (SELECT upper(column_name) FROM (DESCRIBE customer))")
def q14(spark, d):
    return spark.createDataFrame([(c,) for c in quality.columns_absent(read(spark, d, "customer"), ["c_name", "c_phone", "c_absent"])], "forbidden string")


@query("q16_zero_gate", "SELECT count(*) FILTER (WHERE c_custkey IS NULL) = 0 AS passes, count(*) FILTER (WHERE c_acctbal > 0) = 0 AS passes_with_rows, false AS passes_with_null FROM customer")
def q16(spark, d):
    c = read(spark, d, "customer").agg(F.count_if(F.col("c_custkey").isNull()).alias("a"), F.count_if(F.col("c_acctbal") > 0).alias("b")).first()

    def passes(counters):
        try:
            quality.zero_gate(counters)
            return True
        except ValueError:
            return False

    return spark.createDataFrame([(passes({"a": c.a}), passes({"a": c.a, "b": c.b}), passes({"a": None}))], "passes boolean, passes_with_rows boolean, passes_with_null boolean")
