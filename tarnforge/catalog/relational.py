"""Queries of the relational forms that the plans use: joins in roles, aggregates, windows, sets, sorts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tarnforge.catalog.analytics import N, SPAN, labelled
from tarnforge.catalog.analytics import _LABELLED, _SWEEP, _curve, _scale
from tarnforge.catalog.base import DAILY, SCORED, SPARSE, daily, failures, query, read, scored, sparse_lines
from tarnforge.functions import keys, scalar
from tarnforge.operators import clean, cost, events, joins, preprocess, profile, ranks, sampling, sets, splits, star, windows

# ---- projections and predicates


@query("m2_content_hash", "SELECT n_nationkey, sha256('{\"n_name\":\"' || n_name || '\",\"n_regionkey\":' || CASE WHEN n_regionkey = 2 THEN 'null' ELSE CAST(n_regionkey AS VARCHAR) END || '}') AS row_hash FROM nation")
def m2(spark, d):
    n = read(spark, d, "nation").withColumn("n_regionkey", F.when(F.col("n_regionkey") != 2, F.col("n_regionkey")))
    return n.select("n_nationkey", keys.content_hash("n_name", "n_regionkey").alias("row_hash"))


@query("p7_any_and_all", f"WITH {SPARSE} SELECT count(*) FILTER (WHERE l_tax IS NULL OR l_discount IS NULL) AS any_null, count(*) FILTER (WHERE l_tax IS NULL AND l_discount IS NULL) AS all_null FROM sparse")
def p7(spark, d):
    z = [F.col(c).isNull() for c in ("l_tax", "l_discount")]
    return sparse_lines(spark, d).agg(F.count_if(scalar.any_of(z)).alias("any_null"), F.count_if(scalar.all_of(z)).alias("all_null"))


@query("p8_output_scope", f"WITH {DAILY} SELECT count(*) AS n, min(d) AS lo, max(d) AS hi FROM daily WHERE d BETWEEN DATE '2024-01-10' AND DATE '2024-01-12'")
def p8(spark, d):
    return clean.output_scope(daily(spark, d), "d", "2024-01-10", "2024-01-12").agg(F.count("*").alias("n"), F.min("d").alias("lo"), F.max("d").alias("hi"))


@query("p12_distinct_from", f"WITH {SPARSE} SELECT count(*) FILTER (WHERE l_tax IS DISTINCT FROM l_discount) AS differing, count(*) FILTER (WHERE l_tax IS NOT DISTINCT FROM l_discount) AS equal FROM sparse")
def p12(spark, d):
    same = F.col("l_tax").eqNullSafe(F.col("l_discount"))
    return sparse_lines(spark, d).agg(F.count_if(~same).alias("differing"), F.count_if(same).alias("equal"))


@query("p13_conditionals", "SELECT o_orderstatus, coalesce(nullif(o_orderpriority, '5-LOW'), 'none') AS priority, CASE WHEN o_totalprice BETWEEN 1000 AND 100000 THEN 'mid' ELSE 'out' END AS band, count(*) AS n FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1, 2, 3")
def p13(spark, d):
    o = read(spark, d, "orders").where(F.col("o_orderstatus").isin("F", "O"))
    return o.groupBy("o_orderstatus", F.coalesce(F.nullif("o_orderpriority", F.lit("5-LOW")), F.lit("none")).alias("priority"), F.when(F.col("o_totalprice").between(1000, 100000), "mid").otherwise("out").alias("band")).agg(F.count("*").alias("n"))


@query("p14_model_filter", "SELECT c_custkey FROM customer WHERE upper(lower(c_mktsegment)) = 'BUILDING'")
def p14(spark, d):
    return read(spark, d, "customer").where(F.upper(F.lower("c_mktsegment")) == "BUILDING").select("c_custkey")


@query("p20_label_filter_after_window", f"WITH {DAILY} SELECT user_id, d, age FROM (SELECT user_id, d, n, CAST(date_diff('day', min(d) OVER (PARTITION BY user_id ORDER BY d ROWS UNBOUNDED PRECEDING), d) AS INTEGER) AS age FROM daily) WHERE n > 2")
def p20(spark, d):
    return windows.days_since_first_seen(daily(spark, d), "user_id", "d", "age").where("n > 2").select("user_id", "d", "age")


@query("d9_degrading_count", f"WITH {SPARSE} SELECT l_orderkey, l_linenumber, (coalesce(l_tax > 0.04, false))::INT + (coalesce(l_discount > 0.05, false))::INT AS n_degrading FROM sparse")
def d9(spark, d):
    s = sparse_lines(spark, d).select("l_orderkey", "l_linenumber", (F.col("l_tax") - 0.04).alias("R_5_MEAN_SHIFT_30D"), (F.col("l_discount") - 0.05).alias("R_197_MEAN_SHIFT_30D"))
    return s.select("l_orderkey", "l_linenumber", preprocess.n_degrading((5, 197)).alias("n_degrading"))


# ---- joins


@query("j2_key_and_value_join", "SELECT count(*) AS n FROM lineitem a JOIN (SELECT DISTINCT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders) o ON o.o_orderkey = a.l_orderkey AND o.day = CAST(a.l_shipdate AS DATE) - 1")
def j2(spark, d):
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.to_date("o_orderdate").alias("day")).distinct()
    return read(spark, d, "lineitem").withColumn("day", F.date_sub(F.to_date("l_shipdate"), 1)).join(o, ["l_orderkey", "day"]).agg(F.count("*").alias("n"))


@query("j4_left_join_summary", "SELECT c_custkey, f.n_orders, f.first_day FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n_orders, min(CAST(o_orderdate AS DATE)) AS first_day FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) f ON f.o_custkey = c_custkey")
def j4(spark, d):
    f = read(spark, d, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_orders"), F.min(F.to_date("o_orderdate")).alias("first_day"))
    return read(spark, d, "customer").select("c_custkey").join(f, "c_custkey", "left")


@query("j11_bounds_cross_join", "SELECT count(*) AS n FROM orders, (SELECT max(o_orderdate) AS hi FROM orders) WHERE o_orderdate >= hi - INTERVAL 30 DAY")
def j11(spark, d):
    o = read(spark, d, "orders")
    return o.crossJoin(F.broadcast(o.agg(F.max("o_orderdate").alias("hi")))).where("o_orderdate >= hi - INTERVAL 30 DAY").agg(F.count("*").alias("n"))


@query("j13_features_with_labels", _LABELLED + " SELECT sha256(CAST(l.user_id AS VARCHAR) || '|' || CAST(l.d AS VARCHAR)) AS k, l.label_status, y.value FROM l JOIN daily y USING (user_id, d)")
def j13(spark, d):
    k = keys.surrogate_key(F.col("user_id"), F.col("d")).alias("k")
    return labelled(spark, d).select(k, "label_status").join(daily(spark, d).select(k, "value"), "k")


@query("j15_unnested_range", "SELECT n_nationkey, unnest(generate_series(0, n_regionkey)) AS step FROM nation")
def j15(spark, d):
    return read(spark, d, "nation").select("n_nationkey", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_regionkey").cast("long"))).alias("step"))


# ---- aggregates


@query("a1_scalar_aggregate", "SELECT count(*) AS ROWS_ALL, coalesce(sum(CASE WHEN l_tax > 5 THEN 1 END), 0)::BIGINT AS NONE_SO_HIGH, count(DISTINCT l_suppkey) AS SUPPLIERS FROM lineitem")
def a1(spark, d):
    got = profile.scalar(read(spark, d, "lineitem"), {"rows_all": F.count("*"), "none_so_high": F.sum(F.when(F.col("l_tax") > 5, 1)), "suppliers": F.count_distinct("l_suppkey")})
    return spark.createDataFrame([tuple(got.values())], ", ".join(f"{k} long" for k in got))


@query("a4_failure_summary", "SELECT user_id, min(CAST(ts AS DATE)) AS first_failure_date, count(*) AS failure_event_count FROM events WHERE event_type = 'error' AND CAST(ts AS DATE) >= DATE '2024-01-15' GROUP BY 1")
def a4(spark, d):
    from tarnforge.operators import labels

    return labels.failure_summary(failures(spark, d), "user_id", "failure_date")


@query("a5_last_seen", f"WITH {DAILY} SELECT user_id, max(d) AS last_seen_date FROM daily GROUP BY 1")
def a5(spark, d):
    from tarnforge.operators import labels

    return labels.last_seen(daily(spark, d), "user_id", "d")


@query("a6_duplicate_groups", "SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def a6(spark, d):
    from tarnforge.operators import quality

    return quality.unique(read(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("a9_month_rollup", "SELECT strftime(o_orderdate, '%Y-%m') AS month, min(CAST(o_orderdate AS DATE)) AS first_day, max(CAST(o_orderdate AS DATE)) AS last_day, count(*) AS n FROM orders GROUP BY 1")
def a9(spark, d):
    return read(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.min(F.to_date("o_orderdate")).alias("first_day"), F.max(F.to_date("o_orderdate")).alias("last_day"), F.count("*").alias("n"))


@query("a15_approx_percentile", "SELECT l_returnflag, quantile_disc(l_quantity, 0.5) AS median FROM lineitem GROUP BY 1")
def a15(spark, d):
    """Quantities are whole numbers up to 50, so that the approximation is exact here."""
    return read(spark, d, "lineitem").groupBy("l_returnflag").agg(F.percentile_approx("l_quantity", 0.5, 100_000).alias("median"))


# ---- windows


@query("w6_global_rank", "SELECT l_suppkey, n, row_number() OVER (ORDER BY n DESC, l_suppkey) AS place FROM (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1)")
def w6(spark, d):
    return ranks.ordered(read(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n")), [F.desc("n"), F.asc("l_suppkey")])


@query("w6_neighbours", """SELECT o_orderkey, row_number() OVER w AS place, lag(o_totalprice) OVER w AS before, lag(o_orderkey, 3) OVER w AS third_before, lead(o_orderkey, 2) OVER w AS second_behind FROM orders WINDOW w AS (ORDER BY o_orderdate, o_orderkey)""")
def w6_neighbours(spark, d):
    """Places and neighbours in the order of all orders, by ranges of it."""
    o = read(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    out = ranks.ordered(o, [F.asc("o_orderdate"), F.asc("o_orderkey")], "place", {"before": ("o_totalprice", 1), "third_before": ("o_orderkey", 3)}, {"second_behind": ("o_orderkey", 2)})
    return out.select("o_orderkey", "place", "before", "third_before", "second_behind")


@query("w7_running_sum", "SELECT l_suppkey, l_returnflag, sum(n) OVER (PARTITION BY l_suppkey ORDER BY l_returnflag ROWS UNBOUNDED PRECEDING)::BIGINT AS running, (sum(n) OVER (PARTITION BY l_suppkey))::BIGINT AS whole, (sum(n) OVER ())::BIGINT AS total FROM (SELECT l_suppkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2)")
def w7(spark, d):
    g = read(spark, d, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.count("*").alias("n"))
    w = Window.partitionBy("l_suppkey")
    return g.select("l_suppkey", "l_returnflag", F.sum("n").over(w.orderBy("l_returnflag").rowsBetween(Window.unboundedPreceding, 0)).alias("running"), F.sum("n").over(w).alias("whole"), F.sum("n").over(Window.partitionBy()).alias("total"))


@query("w4_range_frame_sql", f"WITH {DAILY} SELECT user_id, d, round(max(value) OVER (PARTITION BY user_id ORDER BY day RANGE BETWEEN 6 PRECEDING AND CURRENT ROW), 6) AS high FROM daily")
def w4(spark, d):
    daily(spark, d).createOrReplaceTempView("_daily")
    return spark.sql("SELECT user_id, d, round(max(value) OVER (PARTITION BY user_id ORDER BY day RANGE BETWEEN 6 PRECEDING AND CURRENT ROW), 6) AS high FROM _daily")


# ---- sets and sorts


@query("u1_union_years", "SELECT year(o_orderdate) AS year, count(*) AS n FROM orders WHERE year(o_orderdate) IN (1996, 1998) GROUP BY 1")
def u1(spark, d):
    o = read(spark, d, "orders")
    return sets.union_years(*[o.where(F.year("o_orderdate") == y) for y in (1996, 1998)]).groupBy(F.year("o_orderdate").alias("year")).agg(F.count("*").alias("n"))


@query("u4_multiset_parity", "SELECT n_regionkey, true AS parity, count(*) FILTER (WHERE s_acctbal < -900) = 0 AS parity_without_debtors FROM supplier JOIN nation ON n_nationkey = s_nationkey GROUP BY 1")
def u4(spark, d):
    """Of each region's suppliers: parity with themselves in another order, and with those that are not deep in debt."""
    s = read(spark, d, "supplier").join(read(spark, d, "nation").select("n_nationkey", "n_regionkey"), F.col("n_nationkey") == F.col("s_nationkey"))
    regions = [r[0] for r in s.select("n_regionkey").distinct().collect()]  # a row a region
    got = []
    for k in regions:
        own = s.where(F.col("n_regionkey") == k)
        got.append((k, sets.same_rows(own, own.orderBy(F.desc("s_suppkey"))), sets.same_rows(own, own.where("s_acctbal >= -900"))))
    return spark.createDataFrame(got, "n_regionkey int, parity boolean, parity_without_debtors boolean")


@query("u7_intersection", "SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT s_suppkey FROM supplier WHERE s_acctbal > 0")
def u7(spark, d):
    return read(spark, d, "lineitem").where("l_returnflag = 'A'").select("l_suppkey").intersect(read(spark, d, "supplier").where("s_acctbal > 0").select("s_suppkey"))


@query("o1_priority_order", "SELECT o_orderpriority, count(*) AS n, row_number() OVER (ORDER BY CASE o_orderpriority WHEN '3-MEDIUM' THEN 0 ELSE 1 END, count(*) DESC, o_orderpriority) AS place FROM orders GROUP BY 1")
def o1(spark, d):
    g = read(spark, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    return g.withColumn("place", F.row_number().over(Window.orderBy(F.when(F.col("o_orderpriority") == "3-MEDIUM", 0).otherwise(1), F.desc("n"), "o_orderpriority")))


@query("o3_nulls_last", f"WITH {SPARSE} SELECT l_orderkey, l_linenumber, l_suppkey, place FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_tax DESC NULLS LAST, l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS place FROM sparse) WHERE place <= 3")
def o3(spark, d):
    return windows.top_k(sparse_lines(spark, d), ["l_suppkey"], [F.desc_nulls_last("l_tax"), *map(F.col, ("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"))], 3).withColumn("place", F.row_number().over(Window.partitionBy("l_suppkey").orderBy(F.desc_nulls_last("l_tax"), "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"))).select("l_orderkey", "l_linenumber", "l_suppkey", "place")


# ---- labels, splits, samples


@query("d2_targets", _LABELLED + " SELECT user_id, count(*) FILTER (WHERE label_status = 'POSITIVE') AS positives, count(*) FILTER (WHERE label_status = 'NEGATIVE') AS negatives, count(*) FILTER (WHERE label_status NOT IN ('POSITIVE', 'NEGATIVE')) AS unusable FROM l GROUP BY 1")
def d2(spark, d):
    t = F.col("target")
    return labelled(spark, d).groupBy("user_id").agg(F.count_if(t == 1).alias("positives"), F.count_if(t == 0).alias("negatives"), F.count_if(t.isNull()).alias("unusable"))


@query("d14_holdout", "SELECT count(*) FILTER (WHERE CAST(o_orderdate AS DATE) <= DATE '1998-09-30') AS train_rows, count(*) FILTER (WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1998-11-01' AND DATE '1998-11-30') AS test_rows FROM orders")
def d14(spark, d):
    train, test = splits.holdout(read(spark, d, "orders"), "o_orderdate", "1998-09-30", "1998-11-01", "1998-11-30")
    return train.agg(F.count("*").alias("train_rows")).crossJoin(test.agg(F.count("*").alias("test_rows")))


@query("d18_healthy_weights", f"WITH {SCORED}, e AS (SELECT user_id, max(CASE WHEN days_to_failure BETWEEN 1 AND 7 THEN 1 ELSE 0 END) AS pos FROM scored GROUP BY 1) SELECT CASE WHEN pos = 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight, count(*) AS entities FROM e WHERE pos = 1 OR (('0x' || substr(md5(CAST(user_id AS VARCHAR) || '5'), 1, 8))::BIGINT % 10000) < 5000 GROUP BY 1")
def d18(spark, d):
    s = sampling.entity_sample(scored(spark, d), "user_id", F.col("days_to_failure").between(1, 7), 0.5, "5")
    return s.select("user_id", "weight").distinct().groupBy("weight").agg(F.count("*").alias("entities"))


@query("d22_unscaled_indicators", f"WITH {SPARSE}, f AS (SELECT l_orderkey, l_linenumber, l_tax IS NULL AS miss, coalesce(l_tax, (SELECT median(l_tax) FROM sparse)) AS t FROM sparse), s AS (SELECT avg(t) AS m, stddev_pop(t) AS sd FROM f) SELECT l_orderkey, l_linenumber, round((t - m) / sd, 5) AS l_tax, miss::INT::DOUBLE AS l_tax_missing FROM f, s")
def d22(spark, d):
    s = sparse_lines(spark, d)
    out = preprocess.Preprocessor(log=False, scale_indicators=False).fit(s, ["l_tax"]).transform(s, ["l_orderkey", "l_linenumber"])
    return out.withColumn("l_tax", F.round("l_tax", 5))


# ---- dimensions and keys


@query("a12_file_dimension", "SELECT sha256(o_orderstatus || '|' || o_orderpriority) AS file_key, o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 2, 3")
def a12(spark, d):
    g = read(spark, d, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))
    return g.withColumn("file_key", keys.surrogate_key(F.col("o_orderstatus"), F.col("o_orderpriority")))


@query("s13_inline_dimension", "SELECT * FROM (VALUES (1, 'Y', 'yes'), (2, 'N', 'no')) AS t(code, flag, label)")
def s13(spark, d):
    return star.values_dimension(spark, [(1, "Y", "yes"), (2, "N", "no")], "code int, flag string, label string")


# ---- events and costs


@query("e8_costs", _SWEEP + " SELECT tau, k, round(cost, 4) AS cost FROM g WHERE k IN (1, 10, 50)")
def e8(spark, d):
    n, months = _scale(spark, d)
    c = _curve(spark, d)[1].crossJoin(F.broadcast(spark.createDataFrame([(1,), (10,), (50,)], "k int")))
    return c.select("tau", "k", F.round(cost.cost_per_1000(F.col("alerts"), F.col("hits"), n, months, F.col("k")), 4).alias("cost"))


@query("e10_apply_thresholds", _SWEEP + " SELECT k, round(CASE WHEN tau = 'Infinity'::DOUBLE THEN cost_without_model ELSE cost END, 3) AS cost FROM sw WHERE k IN (1, 25, 50)")
def e10(spark, d):
    """Thresholds chosen once, applied by one curve."""
    s, c = _curve(spark, d)
    chosen = [(r.k, r.tau) for r in cost.sweep(c, *_scale(spark, d), ks=(1, 25, 50)).collect()]
    got = cost.apply_thresholds(s, "user_id", "day", "value", chosen, SPAN)
    return spark.createDataFrame([(r["k"], round(r["cost"], 3)) for r in got], "k int, cost double")


@query("e20_first_alerts", f"WITH {SCORED}, f AS (SELECT user_id, min(day) AS fd FROM scored WHERE value >= 80 GROUP BY 1) SELECT f.user_id, f.fd AS first_day, s.days_to_failure, CASE WHEN s.days_to_failure > 30 THEN 'early' WHEN s.days_to_failure >= 7 THEN 'in_window' WHEN s.days_to_failure >= 1 THEN 'late' ELSE 'none_ahead' END AS alert_class FROM f JOIN scored s ON s.user_id = f.user_id AND s.day = f.fd")
def e20(spark, d):
    return events.first_alerts(scored(spark, d), "user_id", "day", "value", 80.0)
