"""Queries of sources, merges, projections, joins and sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnforge.catalog.base import DAILY, SPARSE, daily, query, read, sparse_lines
from tarnforge.functions import keys, scalar
from tarnforge.operators import clean, impute, joins, merge, quality, sets, star
from tarnforge.sources import bronze

# ---- sources


@query("s11_guarded_query", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def s11(spark, d):
    read(spark, d, "orders").createOrReplaceTempView("_orders")
    rows = bronze.query_small(spark, "SELECT o_orderstatus, count(*) AS n FROM _orders GROUP BY 1", 100)
    return spark.createDataFrame(rows, "o_orderstatus string, n long")


# ---- merges

_VERSION = "SELECT p_partkey, {name} AS p_name, p_size, sha256({name} || '|' || CAST(p_size AS VARCHAR)) AS row_hash, {stamp} AS stamp FROM part"


@query("m1_merge_by_hash", f"""
WITH t AS ({_VERSION.format(name='p_name', stamp=1)} WHERE p_size > 10),
s AS ({_VERSION.format(name="CASE WHEN p_size > 25 THEN upper(p_name) ELSE p_name END", stamp=2)} WHERE p_size <= 40)
SELECT p_partkey, CASE WHEN s.p_partkey IS NOT NULL AND (t.p_partkey IS NULL OR s.row_hash IS DISTINCT FROM t.row_hash) THEN s.p_name ELSE t.p_name END AS p_name,
  CASE WHEN s.p_partkey IS NOT NULL AND (t.p_partkey IS NULL OR s.row_hash IS DISTINCT FROM t.row_hash) THEN 3 ELSE t.stamp END AS stamp
FROM t FULL JOIN s USING (p_partkey)""")
def m1(spark, d):
    p = read(spark, d, "part")
    versions = []
    for name, part, stamp in ((F.col("p_name"), "p_size > 10", 1), (F.when(F.col("p_size") > 25, F.upper("p_name")).otherwise(F.col("p_name")), "p_size <= 40", 2)):
        v = p.where(part).select("p_partkey", name.alias("p_name"), "p_size")
        versions.append(v.withColumn("row_hash", keys.surrogate_key(F.col("p_name"), F.col("p_size"))).withColumn("stamp", F.lit(stamp)))
    return merge.merge_by_hash(*versions, ["p_partkey"], "row_hash", "stamp", F.lit(3)).select("p_partkey", "p_name", "stamp")


_INCREMENT = """
WITH t AS (SELECT o_orderkey, o_totalprice, o_orderdate FROM orders WHERE o_orderdate <= TIMESTAMP '1998-06-01'),
s AS (SELECT o_orderkey, o_totalprice + 1 AS o_totalprice, o_orderdate FROM orders),
f AS (SELECT * FROM s WHERE o_orderdate {op} (SELECT max(o_orderdate) FROM t))
SELECT o_orderkey, round(o_totalprice, 2) AS price, CAST(o_orderdate AS DATE) AS day FROM f
UNION ALL SELECT o_orderkey, round(o_totalprice, 2), CAST(o_orderdate AS DATE) FROM t WHERE o_orderkey NOT IN (SELECT o_orderkey FROM f)"""


def _incremental(spark, d, strict):
    o = read(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderdate")
    target, source = o.where("o_orderdate <= '1998-06-01'"), o.withColumn("o_totalprice", F.col("o_totalprice") + 1)
    out = merge.incremental(source, target, ["o_orderkey"], "o_orderdate", strict)
    return out.select("o_orderkey", F.round("o_totalprice", 2).alias("price"), F.to_date("o_orderdate").alias("day"))


@query("m3_incremental_strict", _INCREMENT.format(op=">"))
def m3(spark, d):
    return _incremental(spark, d, True)


@query("m4_incremental_inclusive", _INCREMENT.format(op=">="))
def m4(spark, d):
    return _incremental(spark, d, False)


@query("m5_schema_drift", "SELECT n_nationkey, n_name, CAST(NULL AS VARCHAR) AS n_comment, n_regionkey FROM nation")
def m5(spark, d):
    out = merge.reconcile_columns(read(spark, d, "nation"), ["n_nationkey", "n_name", "n_comment"], "sync_all_columns")
    return out.withColumn("n_comment", F.col("n_comment").cast("string"))


_ALL = "l_shipdate DESC, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus"


@query("m6_dedup_latest", f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_shipdate AS DATE) AS ship FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {_ALL}) = 1")
def m6(spark, d):
    order = [F.col("l_shipdate").desc_nulls_last(), *[F.col(c.strip()) for c in _ALL.split(",")[1:]]]
    return merge.dedup_latest(read(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], order).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.to_date("l_shipdate").alias("ship"))


@query("m7_count_missing", "SELECT count(*) AS missing_rows FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)")
def m7(spark, d):
    return merge.count_missing(read(spark, d, "customer"), read(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey"), ["c_custkey"])


# ---- projections and predicates


@query("p1_variant_fields", "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DECIMAL(18,2)) AS k, CAST(NULL AS INTEGER) AS absent FROM events")
def p1(spark, d):
    v = F.parse_json("props")
    return read(spark, d, "events").select("event_id", scalar.variant_field(v, "k", "decimal(18,2)").alias("k"), scalar.variant_field(v, "absent", "int").alias("absent"))


@query("p2_tolerant_casts", "SELECT p_partkey, TRY_CAST(right(p_brand, 2) AS DECIMAL(38,6)) AS n_1, TRY_CAST(p_name AS DECIMAL(38,6)) AS r_1 FROM part")
def p2(spark, d):
    p = read(spark, d, "part").select("p_partkey", F.right("p_brand", F.lit(2)).alias("n_1"), F.col("p_name").alias("r_1"))
    return p.select("p_partkey", *clean.typed_attributes([1]))


@query("p6_null_quarantine", f"WITH {SPARSE} SELECT CASE WHEN l_quantity IS NULL AND l_discount IS NULL AND l_tax IS NULL THEN 'quarantine' ELSE 'clean' END AS side, count(*) AS n FROM sparse GROUP BY 1")
def p6(spark, d):
    good, bad = clean.split_all_null(sparse_lines(spark, d), ["l_quantity", "l_discount", "l_tax"])
    return sets.union_years(*[x.agg(F.count("*").alias("n")).select(F.lit(n).alias("side"), "n") for x, n in ((good, "clean"), (bad, "quarantine"))])


@query("p9_context_scope", f"WITH {DAILY} SELECT user_id, count(*) AS n, min(d) AS first_day, max(d) AS last_day FROM daily WHERE d >= DATE '2024-01-20' - 13 AND d <= DATE '2024-01-22' + 5 GROUP BY 1")
def p9(spark, d):
    s = clean.context_scope(daily(spark, d), "d", "2024-01-20", "2024-01-22", (7,), 5)
    return s.groupBy("user_id").agg(F.count("*").alias("n"), F.min("d").alias("first_day"), F.max("d").alias("last_day"))


@query("p10_first_entities", f"WITH {DAILY} SELECT user_id, d, value FROM daily WHERE user_id IN (SELECT DISTINCT user_id FROM daily ORDER BY 1 LIMIT 20)")
def p10(spark, d):
    return clean.first_entities(daily(spark, d), "user_id", 20).select("user_id", "d", "value")


@query("p11_row_validity", "SELECT count(*) AS n FROM lineitem l JOIN orders o ON o_orderkey = l_orderkey WHERE o_orderdate <= l_shipdate AND l_linenumber BETWEEN 1 AND 265 AND l_quantity BETWEEN 1 AND 265 AND (l_tax IS NULL OR l_tax >= 0) AND (l_discount IS NULL OR l_discount > 0)")
def p11(spark, d):
    j = read(spark, d, "lineitem").join(read(spark, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    return j.where(clean.valid_trip("o_orderdate", "l_shipdate", ["l_linenumber", "l_quantity"], "l_tax", "l_discount")).agg(F.count("*").alias("n"))


@query("p15_code_labels", "SELECT CASE WHEN k = -1 THEN 'NOT_REPORTED' WHEN k = 0 THEN 'Africa' WHEN k = 1 THEN 'America' ELSE 'UNRECOGNIZED' END AS label, count(*) AS n FROM (SELECT CASE WHEN n_regionkey = 4 THEN -1 ELSE n_regionkey END AS k FROM nation) GROUP BY 1")
def p15(spark, d):
    code = F.when(F.col("n_regionkey") != 4, F.col("n_regionkey"))
    return read(spark, d, "nation").groupBy(scalar.code_label(code, {0: "Africa", 1: "America"}).alias("label")).agg(F.count("*").alias("n"))


@query("p16_imputed_quadruple", f"WITH {SPARSE} SELECT qty_method, qty_was_missing, count(*) AS n, sum(coalesce(l_quantity, 0)) AS total FROM (SELECT *, CASE WHEN l_quantity IS NULL THEN 'zero' ELSE 'reported' END AS qty_method, l_quantity IS NULL AS qty_was_missing FROM sparse) GROUP BY 1, 2")
def p16(spark, d):
    s = sparse_lines(spark, d).select(*scalar.imputed_quadruple(F.col("l_quantity"), F.lit(0.0), F.lit("zero"), "qty"))
    return s.groupBy("qty_method", "qty_was_missing").agg(F.count("*").alias("n"), F.sum("qty_normalized").alias("total"))


@query("p17_additive_total", f"WITH {SPARSE} SELECT count(*) AS n, count(l_discount + l_tax) AS known, sum(CASE WHEN l_discount IS NULL THEN 1 ELSE 0 END) AS unknown_discount FROM sparse")
def p17(spark, d):
    s = sparse_lines(spark, d)
    return s.agg(F.count("*").alias("n"), F.count(star.additive_total(["l_discount", "l_tax"])).alias("known"), F.sum(scalar.flag(F.col("l_discount").isNull())).alias("unknown_discount"))


@query("d21_complete_cases", f"WITH {SPARSE} SELECT count(*) AS rows_before, count(*) FILTER (WHERE l_quantity IS NOT NULL AND l_tax IS NOT NULL) AS rows_after FROM sparse")
def d21(spark, d):
    return clean.complete_cases(sparse_lines(spark, d), ["l_quantity", "l_tax"])[1]


# ---- joins


@query("j1_composite_join", "SELECT r_name, n_name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2")
def j1(spark, d):
    n = read(spark, d, "nation").join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).withColumnRenamed("n_nationkey", "c_nationkey")
    return joins.count_preserving_join(read(spark, d, "customer"), n, ["c_nationkey"]).groupBy("r_name", "n_name").agg(F.count("*").alias("customers"))


@query("j5_star_roles", """
WITH days AS (SELECT DISTINCT CAST(year(x) * 10000 + month(x) * 100 + day(x) AS INTEGER) AS k FROM (SELECT o_orderdate AS x FROM orders UNION SELECT l_shipdate FROM lineitem WHERE year(l_shipdate) < 2000))
SELECT a.k AS order_date_key, b.k AS ship_date_key, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey
LEFT JOIN days a ON a.k = year(o_orderdate) * 10000 + month(o_orderdate) * 100 + day(o_orderdate) LEFT JOIN days b ON b.k = year(l_shipdate) * 10000 + month(l_shipdate) * 100 + day(l_shipdate) GROUP BY 1, 2""")
def j5(spark, d):
    o, l = read(spark, d, "orders"), read(spark, d, "lineitem")
    day = lambda c: keys.date_key(F.col(c))
    dim = sets.business_keys(o.select(day("o_orderdate").alias("k")), l.where(F.year("l_shipdate") < 2000).select(day("l_shipdate").alias("k")))
    j = l.join(o, F.col("o_orderkey") == F.col("l_orderkey"))
    return joins.star_join(j, [(dim, "k", day("o_orderdate"), "order_date_key"), (dim, "k", day("l_shipdate"), "ship_date_key")]).groupBy("order_date_key", "ship_date_key").agg(F.count("*").alias("n"))


@query("j7_orphans", "SELECT p_partkey, p_name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')")
def j7(spark, d):
    used = read(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey"))
    return joins.orphans(read(spark, d, "part"), used, ["p_partkey"]).select("p_partkey", "p_name")


@query("j8_reference_errors", "SELECT count(*) FILTER (WHERE o.o_orderkey IS NULL) AS orphan_rows, count(*) FILTER (WHERE o.o_orderkey IS NOT NULL AND o.o_orderstatus IS DISTINCT FROM l_linestatus) AS mismatched_rows FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus <> 'P') o ON o.o_orderkey = l_orderkey")
def j8(spark, d):
    l = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linestatus").alias("v"))
    o = read(spark, d, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("v"))
    return joins.reference_errors(l, o, "k", "v")


_NEAR = """WITH a AS (SELECT event_id, user_id, CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS INTEGER) AS day FROM events WHERE event_type = 'view'),
e AS (SELECT user_id, CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS INTEGER) AS fday FROM events WHERE event_type = 'error')
SELECT event_id, EXISTS (SELECT 1 FROM e WHERE e.user_id = a.user_id AND e.fday BETWEEN a.day + 1 AND a.day + 3) AS fails_soon FROM a"""


def _near(spark, d):
    e = read(spark, d, "events").withColumn("day", keys.epoch_day(F.to_date("ts")))
    return e.where("event_type = 'view'").select("event_id", "user_id", "day"), e.where("event_type = 'error'").select("user_id", F.col("day").alias("fday"))


@query("j10_exists_within", _NEAR)
def j10(spark, d):
    a, e = _near(spark, d)
    return joins.exists_within(a, e, ["user_id"], "day", "fday", 1, 3, "fails_soon").select("event_id", "fails_soon")


@query("j10_existence_join", _NEAR)
def j10_sql(spark, d):
    a, e = _near(spark, d)
    a.createOrReplaceTempView("_obs")
    e.createOrReplaceTempView("_fail")
    return spark.sql(joins.semi_range("_obs", "_fail", ["user_id"], "day", "fday", 1, 3, "fails_soon")).select("event_id", "fails_soon")


@query("j12_late_materialisation", "SELECT o.* REPLACE (CAST(o_orderdate AS DATE) AS o_orderdate) FROM orders o WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49)")
def j12(spark, d):
    k = read(spark, d, "lineitem").where("l_quantity > 49").select(F.col("l_orderkey").alias("o_orderkey"))
    return joins.fetch_wide(k, read(spark, d, "orders"), ["o_orderkey"]).withColumn("o_orderdate", F.to_date("o_orderdate"))


@query("j16_rows_of_repeated_keys", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem QUALIFY count(*) OVER (PARTITION BY l_orderkey, l_linenumber) > 1")
def j16(spark, d):
    return joins.rows_of_repeated_keys(read(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "l_partkey")


@query("j18_one_to_one", "SELECT n_nationkey, a.n_name AS n_name_x, upper(b.n_name) AS n_name_y FROM nation a JOIN nation b USING (n_nationkey)")
def j18(spark, d):
    n = read(spark, d, "nation").select("n_nationkey", "n_name")
    return joins.one_to_one(n, n.withColumn("n_name", F.upper("n_name")), ["n_nationkey"])


@query("j19_as_of", """WITH p AS (SELECT user_id, epoch_us(ts) AS at, max(value) AS v FROM events WHERE event_type = 'purchase' GROUP BY 1, 2)
SELECT e.event_id, p.v AS last_purchase FROM (SELECT event_id, user_id, epoch_us(ts) AS at FROM events WHERE event_type = 'click') e ASOF LEFT JOIN p ON e.user_id = p.user_id AND e.at >= p.at""")
def j19(spark, d):
    e = read(spark, d, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    p = e.where("event_type = 'purchase'").groupBy("user_id", "at").agg(F.max("value").alias("v"))
    return joins.as_of(e.where("event_type = 'click'").select("event_id", "user_id", "at"), p, "user_id", "at", "v", "last_purchase").select("event_id", "last_purchase")


# ---- imputation

_MODE = """WITH c AS (SELECT l_suppkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT l_suppkey, l_linenumber AS mode_value, n AS mode_rows, donors FROM (SELECT *, sum(n) OVER (PARTITION BY l_suppkey) AS donors FROM c) QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, l_linenumber) = 1"""


@query("a7_mode_by", _MODE)
def a7(spark, d):
    return impute.mode_by(read(spark, d, "lineitem"), ["l_suppkey"], "l_linenumber")


@query("a8_impute_hierarchical", f"""WITH {SPARSE},
f AS (SELECT * FROM (SELECT l_suppkey, l_returnflag, l_quantity, count(*) AS n, sum(count(*)) OVER (PARTITION BY l_suppkey, l_returnflag) AS dn FROM sparse WHERE l_quantity IS NOT NULL GROUP BY 1, 2, 3) QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY n DESC, l_quantity) = 1),
c AS (SELECT * FROM (SELECT l_suppkey, l_quantity, count(*) AS n, sum(count(*)) OVER (PARTITION BY l_suppkey) AS dn FROM sparse WHERE l_quantity IS NOT NULL GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, l_quantity) = 1),
y AS (SELECT * FROM (SELECT ship_year, l_quantity, count(*) AS n FROM sparse WHERE l_quantity IS NOT NULL GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY ship_year ORDER BY n DESC, l_quantity) = 1)
SELECT l_quantity_method, l_quantity_was_missing, l_quantity_imputed, count(*) AS n FROM (
  SELECT s.l_quantity IS NULL AS l_quantity_was_missing,
    CASE WHEN s.l_quantity IS NOT NULL THEN 'reported' WHEN f.dn >= 200 THEN 'fine_mode' WHEN c.dn >= 480 THEN 'coarse_mode' WHEN y.n IS NOT NULL THEN 'month_mode' ELSE 'unresolved' END AS l_quantity_method,
    coalesce(s.l_quantity, CASE WHEN f.dn >= 200 THEN f.l_quantity END, CASE WHEN c.dn >= 480 THEN c.l_quantity END, y.l_quantity) AS l_quantity_imputed
  FROM sparse s LEFT JOIN f USING (l_suppkey, l_returnflag) LEFT JOIN c USING (l_suppkey) LEFT JOIN y USING (ship_year)) GROUP BY 1, 2, 3""")
def a8(spark, d):
    levels = [("fine_mode", ["l_suppkey", "l_returnflag"], 200), ("coarse_mode", ["l_suppkey"], 480), ("month_mode", ["ship_year"], None)]
    out = impute.impute_hierarchical(sparse_lines(spark, d), "l_quantity", levels)
    return out.groupBy("l_quantity_method", "l_quantity_was_missing", "l_quantity_imputed").agg(F.count("*").alias("n"))


# ---- sets, keys, dimensions


@query("u2_business_keys", "SELECT o_custkey AS k FROM orders UNION SELECT c_custkey FROM customer")
def u2(spark, d):
    return sets.business_keys(read(spark, d, "orders").select(F.col("o_custkey").alias("k")), read(spark, d, "customer").select(F.col("c_custkey").alias("k")))


@query("u3_difference", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
def u3(spark, d):
    return sets.difference(read(spark, d, "customer").select(F.col("c_custkey").alias("k")), read(spark, d, "orders").select(F.col("o_custkey").alias("k")))


_SIDES = "a AS (SELECT l_suppkey, l_linenumber FROM lineitem WHERE l_returnflag <> 'A'), b AS (SELECT l_suppkey, l_linenumber FROM lineitem WHERE l_returnflag <> 'N')"


def _sides(spark, d):
    l = read(spark, d, "lineitem")
    return l.where("l_returnflag <> 'A'").select("l_suppkey", "l_linenumber"), l.where("l_returnflag <> 'N'").select("l_suppkey", "l_linenumber")


@query("u5_reconcile_multiset", f"WITH {_SIDES} SELECT *, 'missing' AS error FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'unexpected' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)")
def u5(spark, d):
    return sets.reconcile(*_sides(spark, d))


@query("u5_reconcile_sets", f"WITH {_SIDES} SELECT *, 'missing' AS error FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'unexpected' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)")
def u5_sets(spark, d):
    return sets.reconcile(*_sides(spark, d), multiset=False)


@query("u6_lossless_partition", "SELECT count(*) AS errors FROM lineitem WHERE false")
def u6(spark, d):
    l = read(spark, d, "lineitem")
    return sets.lossless_partition(l, l.where("l_tax > 0.04"), l.where("l_tax <= 0.04")).agg(F.count("*").alias("errors"))


@query("d7_surrogate_keys", "SELECT sha256(CAST(c_custkey AS VARCHAR) || '|' || c_mktsegment) AS customer_key, c_custkey, c_mktsegment FROM customer")
def d7(spark, d):
    return star.entity_dimension([read(spark, d, "customer")], ["c_custkey", "c_mktsegment"], "customer_key")


@query("d8_date_dimension", """
WITH b AS (SELECT min(lo) AS lo, max(hi) AS hi FROM (SELECT min(CAST(o_orderdate AS DATE)) AS lo, max(CAST(o_orderdate AS DATE)) AS hi FROM orders UNION ALL SELECT min(CAST(l_shipdate AS DATE)), max(CAST(l_shipdate AS DATE)) FROM lineitem)),
s AS (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS x FROM b)
SELECT CAST(year(x) * 10000 + month(x) * 100 + day(x) AS INTEGER) AS date_key, x AS full_date, year(x) AS year, quarter(x) AS quarter, month(x) AS month, strftime(x, '%b') AS month_name, day(x) AS day,
  weekofyear(x) AS iso_week, isodow(x) AS iso_weekday, strftime(x, '%a') AS day_name, isodow(x) >= 6 AS is_weekend FROM s""")
def d8(spark, d):
    return star.date_dimension(read(spark, d, "orders").select(F.to_date("o_orderdate")), read(spark, d, "lineitem").select(F.to_date("l_shipdate")))


@query("a13_code_dimension", "SELECT DISTINCT coalesce(CASE WHEN s_nationkey = 3 THEN NULL ELSE s_nationkey END, -1) AS code, CASE WHEN coalesce(CASE WHEN s_nationkey = 3 THEN NULL ELSE s_nationkey END, -1) = -1 THEN 'NOT_REPORTED' WHEN s_nationkey = 1 THEN 'one' ELSE 'UNRECOGNIZED' END AS label FROM supplier")
def a13(spark, d):
    s = read(spark, d, "supplier").withColumn("s_nationkey", F.when(F.col("s_nationkey") != 3, F.col("s_nationkey")))
    return star.code_dimension(s, "s_nationkey", {1: "one"}, "code", "label")


# ---- data-quality tests

_TESTS = {
    "not_null": "SELECT count(*) FROM lineitem WHERE l_tax IS NULL", "unique": "SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)",
    "relationship": "SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')", "accepted_values": "SELECT count(DISTINCT l_returnflag) FROM lineitem WHERE l_returnflag NOT IN ('A', 'R')",
    "continuous_spine": "SELECT count(*) FROM (SELECT d, lag(d) OVER (ORDER BY d) AS p FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders)) WHERE d - p <> 1",
    "covers": "SELECT count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)", "same_row_count": "SELECT CASE WHEN (SELECT count(*) FROM orders) <> (SELECT count(*) FROM customer) THEN 1 ELSE 0 END",
    "paired_missingness": f"WITH {SPARSE} SELECT count(*) FROM sparse WHERE (l_tax IS NULL) <> (l_discount IS NULL)", "has_measurement": f"WITH {SPARSE} SELECT count(*) FROM sparse WHERE l_tax IS NULL AND l_discount IS NULL",
    "dimension_attribute": "SELECT count(*) FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA'", "holds": "SELECT count(*) FROM lineitem WHERE NOT (year(l_shipdate) BETWEEN 1995 AND 2000)",
}


@query("q_test_report", " UNION ALL ".join(f"SELECT '{n}' AS test_name, '{'warn' if n == 'unique' else 'error'}' AS severity, CAST(x AS BIGINT) AS failing_rows, x = 0 AS passed FROM ({s}) AS t(x)" for n, s in _TESTS.items()))
def q_report(spark, d):
    l, o, c, s = read(spark, d, "lineitem"), read(spark, d, "orders"), read(spark, d, "customer"), sparse_lines(spark, d)
    q = quality
    dates = o.select(F.to_date("o_orderdate").alias("day")).distinct()
    failing = {
        "unique": q.unique(l, ["l_orderkey", "l_linenumber"]), "relationship": q.relationship(l, "l_orderkey", o.where("o_orderstatus <> 'P'"), "o_orderkey"),
        "accepted_values": q.accepted_values(l, "l_returnflag", ["A", "R"]), "continuous_spine": q.continuous_spine(dates, "day"), "covers": q.covers(o.select(F.col("o_custkey").alias("c_custkey")), c.select("c_custkey")),
        "same_row_count": q.same_row_count(o, c),
        "dimension_attribute": q.dimension_attribute(read(spark, d, "nation").withColumnRenamed("n_regionkey", "r_regionkey"), read(spark, d, "region"), "r_regionkey", "r_name", "ASIA"),
    }
    z = lambda c: F.col(c).isNull()
    rows = {"not_null": (l, z("l_tax")), "holds": (l, ~F.coalesce(F.year("l_shipdate").between(1995, 2000), F.lit(False))), "paired_missingness": (s, z("l_tax") != z("l_discount")), "has_measurement": (s, z("l_tax") & z("l_discount"))}
    checks = [q.Check(n, f, "warn" if n == "unique" else "error") for n, f in failing.items()]
    return q.report([*checks, *[q.Check(n, f, "error", c) for n, (f, c) in rows.items()]])
