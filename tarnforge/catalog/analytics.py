"""Queries of profiling, windows, labels, sampling, preprocessing, event evaluation and costs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tarnforge.catalog.base import DAILY, FAILED, SCORED, SPARSE, daily, failures, query, read, scored, scratch, sparse_lines
from tarnforge.functions.keys import epoch_day, hash_bucket
from tarnforge.functions.lineage import cut
from tarnforge.functions.scalar import signed_log1p
from tarnforge.operators import cost, events, labels, metrics, preprocess, profile, sampling, sketches, splits, windows
from tarnforge.operators.ranks import running_sums
from tarnforge.sources import snapshot

COLS = ["l_quantity", "l_discount", "l_tax"]

# ---- profiling


@query("a2_grain_metrics", f"WITH {DAILY} SELECT count(*) AS row_count, count(DISTINCT value) AS keys, count(DISTINCT (user_id, d)) AS entity_days, count(DISTINCT user_id) AS entities FROM daily")
def a2(spark, d):
    return profile.grain_metrics(daily(spark, d), "value", "user_id", "d")


_NULLS = [f"SELECT ship_year, '{c}' AS column_name, count(*) AS row_count, count(*) - count({c}) AS null_count, round((count(*) - count({c})) / count(*)::DOUBLE, 6) AS null_rate FROM sparse GROUP BY 1" for c in COLS]


@query("a10_null_profile", f"WITH {SPARSE} " + " UNION ALL ".join(_NULLS))
def a10(spark, d):
    return profile.null_profile(sparse_lines(spark, d), ["ship_year"], COLS)


def _co(a, b):
    both = f"count(*) FILTER (WHERE {a} IS NULL AND {b} IS NULL)"
    l, r = f"(count(*) - count({a}))", f"(count(*) - count({b}))"
    div = lambda x: f"round({both}::DOUBLE / nullif({x}, 0), 6)"
    return f"SELECT ship_year, '{a}' AS left_column, '{b}' AS right_column, {l} AS left_nulls, {r} AS right_nulls, {both} AS both_nulls, {div(l)} AS p_right_given_left, {div(r)} AS p_left_given_right, {div(f'({l} + {r} - {both})')} AS jaccard FROM sparse GROUP BY 1"


@query("a11_co_missingness", f"WITH {SPARSE} " + " UNION ALL ".join(_co(a, b) for a, b in (("l_discount", "l_quantity"), ("l_discount", "l_tax"), ("l_quantity", "l_tax"))))
def a11(spark, d):
    return profile.null_correlations(sparse_lines(spark, d), ["ship_year"], COLS)


@query("a18_null_ranking", f"WITH {SPARSE}, u AS (" + " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) - count({c}) AS null_count, count(*) AS n FROM sparse" for c in COLS) + ") SELECT column_name, null_count, round(100.0 * null_count / n, 4)::DOUBLE AS null_pct, row_number() OVER (ORDER BY null_count DESC, column_name) AS null_rank FROM u")
def a18(spark, d):
    return profile.null_counts(sparse_lines(spark, d), COLS)


_PATTERN = "'[' || concat_ws(',', CASE WHEN l_quantity IS NULL THEN '\"l_quantity\"' END, CASE WHEN l_discount IS NULL THEN '\"l_discount\"' END, CASE WHEN l_tax IS NULL THEN '\"l_tax\"' END) || ']'"
_PATTERNS = f"{SPARSE}, g AS (SELECT {_PATTERN} AS pattern_json, (l_quantity IS NULL)::INT + (l_discount IS NULL)::INT + (l_tax IS NULL)::INT AS null_columns, count(*) AS row_count FROM sparse GROUP BY 1, 2)"


@query("a19_null_patterns", f"WITH {_PATTERNS} SELECT sha256(pattern_json) AS pattern_id, pattern_json, null_columns, row_count, round(100.0 * row_count / sum(row_count) OVER (), 4)::DOUBLE AS row_pct, count(*) OVER () AS observed_patterns, row_number() OVER (ORDER BY row_count DESC, pattern_json) AS pattern_rank FROM g")
def a19(spark, d):
    return profile.null_patterns(sparse_lines(spark, d), COLS)


@query("a20_null_count_distribution", f"WITH {_PATTERNS} SELECT null_columns, count(*) AS patterns, sum(row_count)::BIGINT AS row_count, round(100.0 * sum(row_count) / sum(sum(row_count)) OVER (), 4)::DOUBLE AS row_pct FROM g GROUP BY 1")
def a20(spark, d):
    return profile.null_count_distribution(sparse_lines(spark, d), COLS)


_BY_FLAG = f"{SPARSE}, g AS (SELECT l_returnflag, {_PATTERN} AS pattern_json, count(*) AS row_count FROM sparse GROUP BY 1, 2)"


@query("a21_patterns_by_group", f"WITH {_BY_FLAG} SELECT l_returnflag, pattern_json, row_count, round(100.0 * row_count / sum(row_count) OVER (PARTITION BY l_returnflag), 4)::DOUBLE AS group_pct, round(100.0 * row_count / sum(row_count) OVER (PARTITION BY pattern_json), 4)::DOUBLE AS pattern_pct, round(100.0 * sum(row_count) OVER (PARTITION BY l_returnflag ORDER BY row_count DESC, pattern_json ROWS UNBOUNDED PRECEDING) / sum(row_count) OVER (PARTITION BY l_returnflag), 4)::DOUBLE AS cumulative_pct, row_number() OVER (PARTITION BY l_returnflag ORDER BY row_count DESC, pattern_json) AS pattern_rank FROM g")
def a21(spark, d):
    return profile.patterns_by_group(sparse_lines(spark, d), "l_returnflag", COLS)


@query("a22_patterns_to_reach", f"WITH {_PATTERNS}, c AS (SELECT row_count, sum(row_count) OVER (ORDER BY row_count DESC, pattern_json ROWS UNBOUNDED PRECEDING) - row_count AS before, sum(row_count) OVER () AS total FROM g) SELECT count(*) FILTER (WHERE 100.0 * before / total < 90) AS patterns_needed, count(*) AS patterns FROM c")
def a22(spark, d):
    return profile.patterns_to_reach(sparse_lines(spark, d), COLS)


def _year(n, y):
    return f"(SELECT pattern_json, row_number() OVER (ORDER BY row_count DESC, pattern_json) AS rank_{n}, round(100.0 * row_count / sum(row_count) OVER (), 4)::DOUBLE AS pct_{n} FROM (SELECT {_PATTERN} AS pattern_json, count(*) AS row_count FROM sparse WHERE ship_year = {y} GROUP BY 1))"


@query("a23_compare_patterns", f"WITH {SPARSE} SELECT * FROM {_year('a', 1996)} a FULL JOIN {_year('b', 1997)} b USING (pattern_json)")
def a23(spark, d):
    s = sparse_lines(spark, d)
    return profile.compare_patterns(s.where("ship_year = 1996"), s.where("ship_year = 1997"), COLS, ("a", "b"))


@query("a24_feature_availability", f"""WITH {SPARSE} SELECT 'l_discount/l_tax' AS pair, count(*) FILTER (WHERE l_returnflag = 'R' AND l_discount IS NULL) AS left_null, count(*) FILTER (WHERE l_returnflag = 'R' AND l_discount IS NOT NULL) AS left_present,
count(*) FILTER (WHERE l_returnflag = 'R' AND l_tax IS NULL) AS right_null, count(*) FILTER (WHERE l_returnflag = 'R' AND l_tax IS NOT NULL) AS right_present, count(*) FILTER (WHERE l_returnflag = 'R' AND (l_discount IS NULL) = (l_tax IS NULL)) AS same_missing,
count(*) FILTER (WHERE l_returnflag <> 'R' AND (l_discount IS NOT NULL OR l_tax IS NOT NULL)) AS elsewhere, 'available' AS availability FROM sparse""")
def a24(spark, d):
    return profile.feature_availability(sparse_lines(spark, d), [("l_discount", "l_tax")], "l_returnflag", "R")


@query("a14_univariate", "SELECT count(*) AS total_rows, count(l_extendedprice) AS non_null, count(*) - count(l_extendedprice) AS nulls, 0.0::DOUBLE AS null_pct, min(l_extendedprice) AS minimum, quantile_cont(l_extendedprice, 0.25) AS q1, round(avg(l_extendedprice), 6) AS mean, quantile_cont(l_extendedprice, 0.5) AS median, quantile_cont(l_extendedprice, 0.75) AS q3, max(l_extendedprice) AS maximum, round(stddev_samp(l_extendedprice), 6) AS stddev, round(var_samp(l_extendedprice), 4) AS variance FROM lineitem")
def a14(spark, d):
    return profile.univariate(read(spark, d, "lineitem"), "l_extendedprice")


@query("a39_univariate_by_group", "SELECT l_returnflag, count(*) AS total_rows, count(l_quantity) AS non_null, count(*) - count(l_quantity) AS nulls, round(100.0 * (count(*) - count(l_quantity)) / count(*), 4)::DOUBLE AS null_pct, min(l_quantity) AS minimum, quantile_cont(l_quantity, 0.25) AS q1, round(avg(l_quantity), 6) AS mean, quantile_cont(l_quantity, 0.5) AS median, quantile_cont(l_quantity, 0.75) AS q3, max(l_quantity) AS maximum, round(stddev_samp(l_quantity), 6) AS stddev, round(var_samp(l_quantity), 4) AS variance FROM lineitem GROUP BY 1")
def a39(spark, d):
    return profile.univariate(read(spark, d, "lineitem"), "l_quantity", ["l_returnflag"])


@query("a16_histogram", "WITH b AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem) SELECT least(20, 1 + CAST(floor((l_quantity - lo) / ((hi - lo) / 20)) AS BIGINT)) AS bin, min(l_quantity) AS bin_min, max(l_quantity) AS bin_max, count(*) AS row_count FROM lineitem, b GROUP BY 1")
def a16(spark, d):
    return profile.histogram(read(spark, d, "lineitem"), "l_quantity", 20)


@query("a17_pair_interaction", "SELECT count(*) AS pairs, round(covar_samp(l_quantity, l_extendedprice), 4) AS covariance, round(corr(l_quantity, l_extendedprice), 6) AS correlation, round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, CASE WHEN round(corr(l_quantity, l_extendedprice), 6) > 0 THEN 'positive' WHEN round(corr(l_quantity, l_extendedprice), 6) < 0 THEN 'negative' ELSE 'none' END AS direction FROM lineitem")
def a17(spark, d):
    return profile.pair_interaction(read(spark, d, "lineitem"), "l_quantity", "l_extendedprice")


@query("a25_failures_by_year", "SELECT year(ts) AS year, count(*) AS events, count(DISTINCT user_id) AS entities, min(CAST(ts AS DATE)) AS first_day, max(CAST(ts AS DATE)) AS last_day FROM events WHERE event_type = 'error' GROUP BY 1")
def a25(spark, d):
    return read(spark, d, "events").where("event_type = 'error'").groupBy(F.year("ts").alias("year")).agg(F.count("*").alias("events"), F.count_distinct("user_id").alias("entities"), F.min(F.to_date("ts")).alias("first_day"), F.max(F.to_date("ts")).alias("last_day"))


_RISK = f"r AS (SELECT CASE WHEN n > 1 THEN NULL ELSE n END AS x, days_to_failure BETWEEN 1 AND 7 AS failed, day <= (SELECT max(day) FROM scored) - 7 AS complete FROM scored)"


def _risk(spark, d):
    s = scored(spark, d)
    last = s.agg(F.max("day")).first()[0] or 0
    return s.select(F.when(F.col("n") <= 1, F.col("n")).alias("x"), F.coalesce(F.col("days_to_failure").between(1, 7), F.lit(False)).alias("failed"), (F.col("day") <= last - 7).alias("complete"))


@query("a26_pattern_risk", f"WITH {SCORED}, {_RISK}, g AS (SELECT CASE WHEN x IS NULL THEN '[\"x\"]' ELSE '[]' END AS pattern, count(*) AS row_count, count(*) FILTER (WHERE failed) AS failures FROM r WHERE complete GROUP BY 1) SELECT pattern, row_count, failures, round(100.0 * failures / row_count, 4)::DOUBLE AS failure_pct, round(100.0::DOUBLE * failures / row_count - 100.0::DOUBLE * sum(failures) OVER () / sum(row_count) OVER (), 4) AS difference_pp FROM g")
def a26(spark, d):
    return profile.risk_by_pattern(_risk(spark, d), profile.pattern(["x"]), F.col("failed"), F.col("complete"))


@query("a27_missingness_risk", f"WITH {SCORED}, {_RISK}, g AS (SELECT count(*) FILTER (WHERE x IS NULL) AS a, count(*) FILTER (WHERE x IS NULL AND failed) AS b, count(x) AS c, count(*) FILTER (WHERE x IS NOT NULL AND failed) AS e FROM r) SELECT 'x' AS column_name, a AS null_rows, b AS null_failures, c AS present_rows, e AS present_failures, round(100.0 * b / a, 4)::DOUBLE AS null_rate, round(100.0 * e / c, 4)::DOUBLE AS present_rate, round(round(100.0 * b / a, 4)::DOUBLE - round(100.0 * e / c, 4)::DOUBLE, 4) AS difference_pp FROM g")
def a27(spark, d):
    return profile.missingness_risk(_risk(spark, d), ["x"], F.col("failed"))


@query("a28_distribution", "SELECT o_orderstatus, o_orderpriority, count(*) AS row_count, round(100.0 * count(*) / sum(count(*)) OVER (), 4)::DOUBLE AS row_pct FROM orders GROUP BY 1, 2")
def a28(spark, d):
    return profile.distribution(read(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"])


@query("a29_top_co_occurrence", "SELECT l_suppkey, l_returnflag, count(*) AS row_count, round(100.0 * count(*) / sum(count(*)) OVER (), 4)::DOUBLE AS row_pct FROM lineitem GROUP BY 1, 2 ORDER BY row_count DESC, l_suppkey, l_returnflag LIMIT 10")
def a29(spark, d):
    return profile.distribution(read(spark, d, "lineitem"), ["l_suppkey", "l_returnflag"], 10)


@query("a30_listed_values", "SELECT c_nationkey, count(DISTINCT c_mktsegment) AS n_values, string_agg(DISTINCT c_mktsegment, ', ' ORDER BY c_mktsegment) AS value_list FROM customer GROUP BY 1 HAVING count(DISTINCT c_mktsegment) >= 2")
def a30(spark, d):
    return profile.listed(read(spark, d, "customer"), "c_nationkey", "c_mktsegment")


@query("a31_identity_conflicts", "SELECT count(*) AS ids, count(*) FILTER (WHERE n > 1) AS ids_in_conflict, max(n) AS most_values FROM (SELECT l_orderkey, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1)")
def a31(spark, d):
    return profile.identity_conflicts(read(spark, d, "lineitem"), "l_orderkey", "l_suppkey")


@query("a32_duplicate_summary", "SELECT count(*) AS duplicate_groups, coalesce(sum(n), 0)::BIGINT AS rows_in_groups, coalesce(sum(n - 1), 0)::BIGINT AS excess_rows, coalesce(max(n), 0) AS largest_group FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)")
def a32(spark, d):
    return profile.duplicate_summary(read(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("a33_payload_duplicates", "SELECT l_suppkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY l_suppkey, l_linenumber, l_returnflag, l_quantity HAVING count(*) > 1")
def a33(spark, d):
    return profile.payload_duplicates(read(spark, d, "lineitem"), ["l_suppkey", "l_linenumber"], ["l_returnflag", "l_quantity"]).select("l_suppkey", "l_linenumber", "copies")


@query("a34_label_distribution", f"WITH {SCORED} SELECT CASE WHEN days_to_failure < 0 THEN 'post' WHEN days_to_failure = 0 THEN 'same' WHEN days_to_failure BETWEEN 1 AND 7 THEN 'ahead' ELSE 'other' END AS kind, count(*) AS row_count, round(100.0 * count(*) / sum(count(*)) OVER (), 4)::DOUBLE AS row_pct FROM scored GROUP BY 1")
def a34(spark, d):
    x = F.col("days_to_failure")
    kind = F.when(x < 0, "post").when(x == 0, "same").when(x.between(1, 7), "ahead").otherwise("other")
    return profile.distribution(scored(spark, d).withColumn("kind", kind), ["kind"])


@query("a35_conditional_distinct", "SELECT l_returnflag, count(DISTINCT CASE WHEN l_quantity > 25 THEN l_suppkey END) AS suppliers FROM lineitem GROUP BY 1")
def a35(spark, d):
    return read(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count_distinct(F.when(F.col("l_quantity") > 25, F.col("l_suppkey"))).alias("suppliers"))


@query("a36_flag_overlap", "SELECT count(*) AS entities, count(*) FILTER (WHERE a = 1) AS with_big, count(*) FILTER (WHERE b = 1) AS with_returned, count(*) FILTER (WHERE a + b = 2) AS with_all, count(*) FILTER (WHERE a + b = 0) AS with_none FROM (SELECT l_orderkey, max(CASE WHEN l_quantity > 45 THEN 1 ELSE 0 END) AS a, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS b FROM lineitem GROUP BY 1)")
def a36(spark, d):
    return profile.flag_overlap(read(spark, d, "lineitem"), "l_orderkey", {"big": F.col("l_quantity") > 45, "returned": F.col("l_returnflag") == "R"})


@query("a37_days_per_entity", f"WITH {DAILY} SELECT days, count(*) AS entities FROM (SELECT user_id, count(DISTINCT d) AS days FROM daily GROUP BY 1) GROUP BY 1")
def a37(spark, d):
    return profile.days_per_entity(daily(spark, d), "user_id", "d")


@query("a37_days_summary", f"WITH {DAILY} SELECT count(*) AS entities, min(x) AS minimum, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.75) AS q3, max(x) AS maximum, count(*) FILTER (WHERE x >= 7) AS at_least_7, count(*) FILTER (WHERE x >= 14) AS at_least_14, count(*) FILTER (WHERE x >= 21) AS at_least_21 FROM (SELECT count(DISTINCT d) AS x FROM daily GROUP BY user_id)")
def a37_summary(spark, d):
    return profile.days_per_entity_summary(daily(spark, d), "user_id", "d")


@query("a38_positives_by_lead", f"WITH {SCORED} SELECT days_to_failure, count(*) AS n FROM scored WHERE days_to_failure BETWEEN 1 AND 30 GROUP BY 1")
def a38(spark, d):
    return scored(spark, d).where("days_to_failure BETWEEN 1 AND 30").groupBy("days_to_failure").agg(F.count("*").alias("n"))


@query("a40_iqr_outliers", "WITH b AS (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem GROUP BY 1), c AS (SELECT *, round(q1 - 0.1 * (q3 - q1), 6) AS low, round(q3 + 0.1 * (q3 - q1), 6) AS high FROM b) SELECT l_returnflag, q1, q3, low, high, count(l_extendedprice) AS non_null, count(*) FILTER (WHERE l_extendedprice < low OR l_extendedprice > high) AS outliers FROM lineitem JOIN c USING (l_returnflag) GROUP BY 1, 2, 3, 4, 5")
def a40(spark, d):
    return profile.iqr_outliers(read(spark, d, "lineitem"), "l_extendedprice", ["l_returnflag"], 0.1)


_Y = "CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END"


def _lines_y(spark, d):
    return read(spark, d, "lineitem").withColumn("y", F.when(F.col("l_returnflag") == "R", 1).otherwise(0))


@query("a41_outlier_lift", f"""WITH l AS (SELECT *, {_Y} AS y FROM lineitem), b AS (SELECT quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.75) AS q3, avg(l_extendedprice) AS m, stddev_pop(l_extendedprice) AS s, avg(y) AS base, count(*) AS n FROM l),
f AS (SELECT y, l_extendedprice < q1 - 1.5 * (q3 - q1) OR l_extendedprice > q3 + 1.5 * (q3 - q1) AS o1, abs(l_extendedprice - m) / s >= 2 AS o2, base, n FROM l, b)
SELECT 'iqr' AS rule, count(*) FILTER (WHERE o1) AS outliers, round(100.0 * count(*) FILTER (WHERE o1) / max(n), 4)::DOUBLE AS outlier_pct, round(avg(y) FILTER (WHERE o1) / max(base), 4) AS lift FROM f
UNION ALL SELECT 'zscore', count(*) FILTER (WHERE o2), round(100.0 * count(*) FILTER (WHERE o2) / max(n), 4)::DOUBLE, round(avg(y) FILTER (WHERE o2) / max(base), 4) FROM f""")
def a41(spark, d):
    return profile.outlier_lift(_lines_y(spark, d), "l_extendedprice", "y", 2.0)


@query("a42_descriptives", "WITH m AS (SELECT avg(l_extendedprice) AS m FROM lineitem) SELECT quantile_cont(l_extendedprice, 0.5) AS p50, quantile_cont(l_extendedprice, 0.9) AS p90, quantile_cont(l_extendedprice, 0.99) AS p99, quantile_cont(l_extendedprice, 0.999) AS p999, round(100.0 * count(*) FILTER (WHERE l_extendedprice = 0) / count(l_extendedprice), 4)::DOUBLE AS zero_pct, round(avg(power(l_extendedprice - m, 3)) / power(stddev_pop(l_extendedprice), 3), 4) AS skew, round(kurtosis_pop(l_extendedprice), 4) AS kurtosis, count(DISTINCT l_extendedprice) AS n_unique FROM lineitem, m")
def a42(spark, d):
    return profile.descriptives(read(spark, d, "lineitem"), "l_extendedprice")


@query("a43_monthly_prevalence", "SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS month, count(*) AS row_count, round(avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS prevalence, count(DISTINCT l_suppkey) AS entities, count(DISTINCT CASE WHEN l_quantity > 49 THEN l_suppkey END) AS event_entities, round(1000.0 * count(DISTINCT CASE WHEN l_quantity > 49 THEN l_suppkey END) / count(DISTINCT l_suppkey), 4)::DOUBLE AS events_per_1000 FROM lineitem GROUP BY 1")
def a43(spark, d):
    l = read(spark, d, "lineitem").withColumn("ship", F.to_date("l_shipdate"))
    return profile.monthly_prevalence(l, "ship", "l_suppkey", F.col("l_returnflag") == "R", F.col("l_quantity") > 49)


def _rank(c):
    return f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0"


@query("a44_rank_correlations", f"WITH l AS (SELECT *, {_Y} AS y FROM lineitem), r AS (SELECT l_quantity, l_extendedprice, y, {_rank('l_quantity')} AS a, {_rank('l_extendedprice')} AS b, {_rank('y')} AS c FROM l) SELECT 'l_quantity' AS column_name, round(corr(l_quantity, y), 6) AS pearson, round(corr(a, c), 6) AS spearman FROM r UNION ALL SELECT 'l_extendedprice', round(corr(l_extendedprice, y), 6), round(corr(b, c), 6) FROM r")
def a44(spark, d):
    return profile.rank_correlations(_lines_y(spark, d), ["l_quantity", "l_extendedprice"], "y")


@query("a44_rank_matrix", f"WITH r AS (SELECT {_rank('l_quantity')} AS a, {_rank('l_extendedprice')} AS b FROM lineitem) SELECT 'l_quantity' AS left_column, 'l_extendedprice' AS right_column, round(corr(a, b), 6) AS spearman FROM r")
def a44_matrix(spark, d):
    return profile.rank_matrix(read(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"], 0.0)


@query("a45_quantile_lift", f"""WITH l AS (SELECT l_quantity AS x, {_Y} AS y FROM lineitem), e AS (SELECT unnest(list_distinct(quantile_cont(x, [0, 0.2, 0.4, 0.6, 0.8, 1]))) AS e FROM l), b AS (SELECT avg(y) AS base FROM l)
SELECT bin, count(*) AS row_count, min(x) AS low, max(x) AS high, round(avg(y), 6) AS prevalence, round(avg(y) / max(base), 4) AS lift FROM (SELECT x, y, greatest((SELECT count(*) FROM e WHERE e.e < l.x), 1)::INTEGER AS bin FROM l), b GROUP BY 1""")
def a45(spark, d):
    return profile.quantile_lift(_lines_y(spark, d), "l_quantity", "y", 5)


@query("a46_value_lift", f"WITH l AS (SELECT l_linenumber, {_Y} AS y FROM lineitem) SELECT l_linenumber, count(*) AS row_count, round(avg(y), 6) AS prevalence, round(100.0 * count(*) / sum(count(*)) OVER (), 4)::DOUBLE AS row_pct, round(avg(y) / (sum(sum(y)) OVER () / sum(count(*)) OVER ()), 4) AS lift FROM l GROUP BY 1")
def a46(spark, d):
    return profile.value_lift(_lines_y(spark, d), "l_linenumber", "y")


@query("a48_quality_ratios", f"WITH {SPARSE} SELECT l_linestatus, sum(CASE WHEN l_tax IS NULL THEN 1 ELSE 0 END)::BIGINT AS missing_tax, count(*) AS n, round(sum(CASE WHEN l_tax IS NULL THEN 1 ELSE 0 END)::DOUBLE / count(*), 6) AS missing_ratio FROM sparse GROUP BY 1")
def a48(spark, d):
    g = sparse_lines(spark, d).groupBy("l_linestatus").agg(F.count_if(F.col("l_tax").isNull()).alias("missing_tax"), F.count("*").alias("n"))
    return g.withColumn("missing_ratio", F.round(F.col("missing_tax") / F.col("n"), 6))


@query("a49_crosstab", "SELECT l_linestatus, count(*) FILTER (WHERE l_returnflag = 'A') AS n_A, count(*) FILTER (WHERE l_returnflag = 'N') AS n_N, count(*) FILTER (WHERE l_returnflag = 'R') AS n_R, count(*) AS total FROM lineitem GROUP BY 1")
def a49(spark, d):
    return profile.crosstab(read(spark, d, "lineitem"), "l_linestatus", "l_returnflag", ["A", "N", "R"])


# ---- windows and labels

_ROLL = f"""WITH {DAILY}, r AS (SELECT user_id, d, avg(value) OVER c AS m, count(value) OVER c AS k, avg(value) OVER p AS pm, count(value) OVER p AS pk FROM daily
WINDOW c AS (PARTITION BY user_id ORDER BY day RANGE BETWEEN 6 PRECEDING AND CURRENT ROW), p AS (PARTITION BY user_id ORDER BY day RANGE BETWEEN 13 PRECEDING AND 7 PRECEDING))"""


@query("w1_rolling_windows", _ROLL + " SELECT user_id, d, round(m + 1e-7, 4) AS mean_7d, k AS count_7d, round(pm + 1e-7, 4) AS prev_mean_7d, pk AS prev_count_7d FROM r")
def w1(spark, d):
    r = windows.rolling(daily(spark, d), "user_id", "day", ["value"], (7,))
    return r.select("user_id", "d", F.round(F.col("value_MEAN_7D") + 1e-7, 4).alias("mean_7d"), F.col("value_COUNT_7D").alias("count_7d"), F.round(F.col("value_PREV_MEAN_7D") + 1e-7, 4).alias("prev_mean_7d"), F.col("value_PREV_COUNT_7D").alias("prev_count_7d"))


@query("w1_over_entity_cache", _ROLL + " SELECT user_id, d, round(m + 1e-7, 4) AS mean_7d, k AS count_7d, n_events FROM r JOIN (SELECT user_id, count(*) AS n_events FROM events GROUP BY 1) USING (user_id)")
def w1_cached(spark, d):
    """Windows, and a join by the entity, over a table in sorted buckets."""
    name = f"_cache_{uuid.uuid4().hex}"
    cached = snapshot.entity_cache(daily(spark, d), name, "user_id", "day", 8)
    n = read(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n_events"))
    r = windows.rolling(cached, "user_id", "day", ["value"], (7,)).join(n, "user_id")
    out = cut(r.select("user_id", "d", F.round(F.col("value_MEAN_7D") + 1e-7, 4).alias("mean_7d"), F.col("value_COUNT_7D").alias("count_7d"), "n_events"))
    spark.sql(f"DROP TABLE {name}")
    return out


@query("w3_mean_shift", _ROLL + " SELECT user_id, d, (k > 0)::INT AS valid, round(CASE WHEN k > 0 AND pk > 0 THEN m - pm END + 1e-7, 4) AS shift, (k > 0 AND pk > 0)::INT AS shift_valid FROM r")
def w3(spark, d):
    r = windows.with_shifts(windows.rolling(daily(spark, d), "user_id", "day", ["value"], (7,)), ["value"], (7,))
    return r.select("user_id", "d", F.col("value_MEAN_VALID_7D").alias("valid"), F.round(F.col("value_MEAN_SHIFT_7D") + 1e-7, 4).alias("shift"), F.col("value_MEAN_SHIFT_VALID_7D").alias("shift_valid"))


@query("w5_top_k", "SELECT c_nationkey, c_custkey, c_acctbal FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) <= 3")
def w5(spark, d):
    return windows.top_k(read(spark, d, "customer"), ["c_nationkey"], [F.desc("c_acctbal"), F.col("c_custkey")], 3).select("c_nationkey", "c_custkey", "c_acctbal")


@query("w10_gap_detection", f"WITH {DAILY}, g AS (SELECT DISTINCT d FROM daily WHERE d NOT IN (DATE '2024-01-10', DATE '2024-01-11')) SELECT d, previous FROM (SELECT d, lag(d) OVER (ORDER BY d) AS previous FROM g) WHERE d - previous <> 1")
def w10(spark, d):
    days = daily(spark, d).select("d").distinct().where("d NOT IN (DATE '2024-01-10', DATE '2024-01-11')")
    return windows.gaps(days, "d")


@query("w11_days_since_first_seen", f"WITH {DAILY} SELECT user_id, d, CAST(date_diff('day', min(d) OVER (PARTITION BY user_id ORDER BY d ROWS UNBOUNDED PRECEDING), d) AS INTEGER) AS age FROM daily")
def w11(spark, d):
    return windows.days_since_first_seen(daily(spark, d), "user_id", "d", "age").select("user_id", "d", "age")


@query("o2_top_n", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 0 ELSE 1 END, o_totalprice DESC, o_orderkey LIMIT 25")
def o2(spark, d):
    o = read(spark, d, "orders").orderBy(F.when(F.col("o_orderpriority") == "1-URGENT", 0).otherwise(1), F.desc_nulls_last("o_totalprice"), "o_orderkey").limit(25)
    return o.select("o_orderkey", "o_totalprice")


_LABELLED = f"""WITH {DAILY}, {FAILED}, seen AS (SELECT user_id, max(d) AS last_seen FROM daily GROUP BY 1), l AS (
SELECT y.user_id, y.d, CAST(date_diff('day', y.d, f.ff) AS INTEGER) AS days_to_failure, coalesce(f.nf, 0) AS nf,
  CASE WHEN y.d > f.ff THEN 'POST_FAILURE' WHEN y.d = f.ff THEN 'SAME_DAY_FAILURE' WHEN date_diff('day', y.d, f.ff) BETWEEN 1 AND 7 THEN 'POSITIVE' WHEN date_diff('day', y.d, s.last_seen) >= 7 THEN 'NEGATIVE' ELSE 'CENSORED' END AS label_status
FROM daily y LEFT JOIN failed f USING (user_id) LEFT JOIN seen s USING (user_id))"""


def labelled(spark, d):
    return labels.label_horizon(daily(spark, d), failures(spark, d), "user_id", "d", "failure_date", 7)


@query("d1_horizon_labels", _LABELLED + " SELECT user_id, d, days_to_failure, nf AS failure_event_count, label_status, CASE label_status WHEN 'POSITIVE' THEN 1 WHEN 'NEGATIVE' THEN 0 END AS target FROM l")
def d1(spark, d):
    return labelled(spark, d).select("user_id", "d", "days_to_failure", F.coalesce("failure_event_count", F.lit(0)).alias("failure_event_count"), "label_status", "target")


@query("d6_label_diagnostics", _LABELLED + " SELECT year(d) AS year, label_status, count(*) AS row_count FROM l GROUP BY 1, 2")
def d6(spark, d):
    from tarnforge.plans import wide_table

    stage = labelled(spark, d).select(F.col("d").alias("OBSERVATION_DATE"), F.col("label_status").alias("LABEL_STATUS"))
    return wide_table.years_by_label(stage).withColumnRenamed("LABEL_STATUS", "label_status")


FLAGSHIP = """WITH {daily}, {failed}, seen AS (SELECT user_id, max(d) AS last_seen FROM daily GROUP BY 1), r AS (
SELECT user_id, d, avg(value) OVER c AS m, count(value) OVER c AS k, avg(value) OVER p AS pm, count(value) OVER p AS pk FROM daily
WINDOW c AS (PARTITION BY user_id ORDER BY day RANGE BETWEEN 6 PRECEDING AND CURRENT ROW), p AS (PARTITION BY user_id ORDER BY day RANGE BETWEEN 13 PRECEDING AND 7 PRECEDING))
SELECT CASE WHEN r.d > f.ff THEN 'POST_FAILURE' WHEN r.d = f.ff THEN 'SAME_DAY_FAILURE' WHEN date_diff('day', r.d, f.ff) BETWEEN 1 AND 7 THEN 'POSITIVE' WHEN date_diff('day', r.d, s.last_seen) >= 7 THEN 'NEGATIVE' ELSE 'CENSORED' END AS label_status,
  count(*) AS row_count, sum(k)::BIGINT AS values_seen, count(*) FILTER (WHERE k > 0 AND pk > 0) AS with_shift, round(avg(CASE WHEN k > 0 AND pk > 0 THEN m - pm END), 4) AS mean_shift
FROM r LEFT JOIN failed f USING (user_id) LEFT JOIN seen s USING (user_id) GROUP BY 1""".format(daily=DAILY, failed=FAILED)


@query("flagship_telemetry_labels", FLAGSHIP)
def flagship(spark, d):
    """Scan, daily grain, rolling windows and shift, horizon label, status report."""
    x = daily(spark, d)
    r = windows.with_shifts(windows.rolling(x, "user_id", "day", ["value"], (7,)), ["value"], (7,))
    l = labels.label_horizon(r, failures(spark, d), "user_id", "d", "failure_date", 7)
    return l.groupBy("label_status").agg(F.count("*").alias("row_count"), F.sum("value_COUNT_7D").alias("values_seen"), F.sum("value_MEAN_SHIFT_VALID_7D").alias("with_shift"), F.round(F.avg("value_MEAN_SHIFT_7D"), 4).alias("mean_shift"))


# ---- sampling, splits, preprocessing


@query("d15_three_way_split", "SELECT part, count(*) AS n FROM (SELECT CASE WHEN CAST(o_orderdate AS DATE) <= DATE '1998-06-30' THEN 'train' WHEN CAST(o_orderdate AS DATE) BETWEEN DATE '1998-08-01' AND DATE '1999-01-31' THEN 'validation' WHEN CAST(o_orderdate AS DATE) BETWEEN DATE '1999-03-01' AND DATE '1999-12-31' THEN 'test' END AS part FROM orders) GROUP BY 1")
def d15(spark, d):
    part = splits.three_way(F.col("o_orderdate"), "1998-06-30", ("1998-08-01", "1999-01-31"), ("1999-03-01", "1999-12-31"))
    return read(spark, d, "orders").groupBy(part.alias("part")).agg(F.count("*").alias("n"))


@query("d13_embargo_folds", """WITH e AS (SELECT date_trunc('month', max(o_orderdate)) + INTERVAL 1 MONTH AS e FROM orders), f AS (SELECT i AS fold, CAST(e - to_months(CAST((4 - i) * 2 AS INTEGER)) AS DATE) AS a FROM e, range(4) t(i))
SELECT fold, count(*) FILTER (WHERE CAST(o_orderdate AS DATE) < a - 30) AS train_rows, count(*) FILTER (WHERE CAST(o_orderdate AS DATE) >= a AND CAST(o_orderdate AS DATE) < CAST(a + INTERVAL 2 MONTH AS DATE)) AS validation_rows FROM f, orders GROUP BY 1""")
def d13(spark, d):
    o = read(spark, d, "orders").withColumn("day", F.to_date("o_orderdate"))
    folds = splits.embargo_folds(o, "day")
    inside = [F.count_if(F.col("day") < F.lit(f.train_end)).alias(f"t{i}") for i, f in enumerate(folds)] + [F.count_if((F.col("day") >= F.lit(f.start)) & (F.col("day") < F.lit(f.end))).alias(f"v{i}") for i, f in enumerate(folds)]
    return o.agg(*inside).select(F.expr("stack(4, " + ", ".join(f"{i}L, t{i}, v{i}" for i in range(4)) + ") AS (fold, train_rows, validation_rows)"))


def _bucket(c, n, seed=""):
    return f"(('0x' || substr(md5(CAST({c} AS VARCHAR) || '{seed}'), 1, 8))::BIGINT % {n})"


@query("d17_entity_sample", f"WITH {SCORED}, e AS (SELECT user_id, max(CASE WHEN days_to_failure BETWEEN 1 AND 7 THEN 1 ELSE 0 END) AS pos FROM scored GROUP BY 1) SELECT s.user_id, s.d, CASE WHEN pos = 1 THEN 1.0::DOUBLE ELSE 4.0::DOUBLE END AS weight FROM scored s JOIN e USING (user_id) WHERE pos = 1 OR {_bucket('user_id', 10000, '7')} < 2500")
def d17(spark, d):
    return sampling.entity_sample(scored(spark, d), "user_id", F.col("days_to_failure").between(1, 7), 0.25, "7").select("user_id", "d", "weight")


@query("d16_quota_sample", f"""WITH o AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y, CASE WHEN o_orderdate < TIMESTAMP '1999-01-01' THEN 'train' WHEN o_orderdate >= TIMESTAMP '1999-06-01' THEN 'test' END AS part FROM orders),
k AS (SELECT *, CASE WHEN part = 'train' THEN y END AS c FROM o WHERE part IS NOT NULL AND (part <> 'train' OR y = 1 OR {_bucket('o_orderkey', 10000, '3')} < 2000))
SELECT part, y, o_orderkey FROM k QUALIFY row_number() OVER (PARTITION BY part, c ORDER BY md5(CAST(o_orderkey AS VARCHAR) || '|3')) <= CASE WHEN part = 'train' AND y = 1 THEN 300 WHEN part = 'train' THEN 400 ELSE 250 END""")
def d16(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("y"), F.when(F.col("o_orderdate") < "1999-01-01", "train").when(F.col("o_orderdate") >= "1999-06-01", "test").alias("part"))
    return sampling.quota_sample(o, F.col("o_orderkey"), "y", "part", "train", 0.2, {1: 300, 0: 400}, 250, "3").select("part", "y", "o_orderkey")


@query("o5_stable_sample", "SELECT c_custkey, c_mktsegment FROM customer ORDER BY sha256(CAST(c_custkey AS VARCHAR)), c_custkey LIMIT 100")
def o5(spark, d):
    return sampling.stable_sample(read(spark, d, "customer"), F.col("c_custkey"), 100).select("c_custkey", "c_mktsegment")


@query("d0_hash_buckets", f"SELECT CAST({_bucket('c_custkey', 16)} AS INTEGER) AS bucket, count(*) AS n FROM customer GROUP BY 1")
def d0(spark, d):
    return read(spark, d, "customer").groupBy(hash_bucket(F.col("c_custkey"), 16).alias("bucket")).agg(F.count("*").alias("n"))


@query("ml8_class_ratio", "SELECT count(*) FILTER (WHERE quality = 1) AS positives, count(*) FILTER (WHERE quality = 0) AS negatives, round(count(*) FILTER (WHERE quality = 0)::DOUBLE / count(*) FILTER (WHERE quality = 1), 6) AS ratio FROM labels")
def ml8(spark, d):
    return sampling.class_ratio(read(spark, d, "labels"), "quality")


@query("d10_signed_log1p", "SELECT c_custkey, round(sign(c_acctbal) * ln(1 + abs(c_acctbal)), 6) AS x FROM customer")
def d10(spark, d):
    return read(spark, d, "customer").select("c_custkey", F.round(signed_log1p(F.col("c_acctbal")), 6).alias("x"))


@query("d11_preprocess", f"""WITH {SPARSE}, v AS (SELECT l_orderkey, l_linenumber, sign(l_quantity) * ln(1 + abs(l_quantity)) AS q, sign(l_tax) * ln(1 + abs(l_tax)) AS t FROM sparse),
m AS (SELECT median(q) AS mq, median(t) AS mt, 1 - count(q)::DOUBLE / count(*) AS zq, 1 - count(t)::DOUBLE / count(*) AS zt FROM v), f AS (SELECT l_orderkey, l_linenumber, q, t, coalesce(q, mq) AS fq, coalesce(t, mt) AS ft FROM v, m),
s AS (SELECT avg(fq) AS aq, stddev_pop(fq) AS sq, avg(ft) AS a_t, stddev_pop(ft) AS s_t FROM f)
SELECT l_orderkey, l_linenumber, round((fq - aq) / sq, 5) AS l_quantity, round((ft - a_t) / s_t, 5) AS l_tax, round(((q IS NULL)::INT - zq) / sqrt(zq * (1 - zq)), 5) AS l_quantity_missing, round(((t IS NULL)::INT - zt) / sqrt(zt * (1 - zt)), 5) AS l_tax_missing FROM f, m, s""")
def d11(spark, d):
    s = sparse_lines(spark, d)
    out = preprocess.Preprocessor().fit(s, ["l_quantity", "l_tax"]).transform(s, ["l_orderkey", "l_linenumber"])
    return out.select("l_orderkey", "l_linenumber", *[F.round(c, 5).alias(c) for c in out.columns[2:]])


@query("d12_ecdf_score", f"WITH {DAILY}, t AS (SELECT value FROM daily WHERE d < DATE '2024-01-16') SELECT user_id, d, round((SELECT count(*) FROM t WHERE t.value <= y.value)::DOUBLE / (SELECT count(*) FROM t), 6) AS score FROM daily y")
def d12(spark, d):
    y = daily(spark, d)
    return preprocess.ecdf_score(y.where("d < DATE '2024-01-16'"), y, "value").select("user_id", "d", F.round("score", 6).alias("score"))


@query("d20_feature_filter", f"WITH {SPARSE} SELECT count(*) FILTER (WHERE l_tax IS NULL)::DOUBLE / count(*) <= 0.05 AS tax_kept, count(*) FILTER (WHERE l_extendedprice IS NULL)::DOUBLE / count(*) <= 0.05 AS price_kept FROM sparse")
def d20(spark, d):
    kept = preprocess.select_features(sparse_lines(spark, d), ["l_tax", "l_extendedprice"])
    return spark.createDataFrame([("l_tax" in kept, "l_extendedprice" in kept)], "tax_kept boolean, price_kept boolean")


@query("e17_seen_entities", "SELECT seen, count(*) AS n FROM (SELECT o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderdate < TIMESTAMP '1995-06-01') AS seen FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01') GROUP BY 1")
def e17(spark, d):
    o = read(spark, d, "orders")
    return splits.seen_entities(o.where("o_orderdate >= '2000-01-01'"), o.where("o_orderdate < '1995-06-01'"), "o_custkey").groupBy("seen").agg(F.count("*").alias("n"))


# ---- event evaluation

TAU, SPAN, N = 60.0, 7, 12


def _episode_ctes(taus: str) -> str:
    return f"""{SCORED}, taus AS ({taus}), hot AS (SELECT t.tau, user_id, day, days_to_failure AS lead FROM scored, taus t WHERE value >= t.tau),
nxt AS (SELECT a.tau, a.user_id, a.day, min(b.day) AS nd FROM hot a LEFT JOIN hot b ON a.tau = b.tau AND a.user_id = b.user_id AND b.day >= a.day + {SPAN} GROUP BY 1, 2, 3),
ep AS (SELECT tau, user_id, min(day) AS day FROM hot GROUP BY 1, 2 UNION ALL SELECT n.tau, n.user_id, n.nd FROM ep JOIN nxt n ON n.tau = ep.tau AND n.user_id = ep.user_id AND n.day = ep.day WHERE n.nd IS NOT NULL),
opened AS (SELECT ep.tau, ep.user_id, ep.day, h.lead, CASE WHEN h.lead BETWEEN 7 AND 30 THEN 'hit' WHEN h.lead >= 1 AND h.lead < 7 THEN 'late' ELSE 'false_alarm' END AS outcome FROM ep JOIN hot h ON h.tau = ep.tau AND h.user_id = ep.user_id AND h.day = ep.day)"""


_ONE = f"SELECT {TAU}::DOUBLE AS tau"
_RANKS = f"SELECT DISTINCT v AS tau FROM (SELECT value AS v, row_number() OVER (ORDER BY value DESC) AS r FROM scored) WHERE r IN (SELECT CAST(round(pow(10, i * log10((SELECT count(*) FROM scored)) / {N - 1})) AS BIGINT) FROM range({N}) t(i))"
_CURVE = f"WITH RECURSIVE {_episode_ctes(_RANKS)}, c AS (SELECT tau, count(*)::DOUBLE AS alerts, count(*) FILTER (WHERE outcome = 'hit')::DOUBLE AS hits, count(*) FILTER (WHERE outcome = 'late')::DOUBLE AS late FROM opened GROUP BY 1), ev AS (SELECT count(DISTINCT user_id) AS events FROM scored WHERE days_to_failure BETWEEN 7 AND 30), ex AS (SELECT count(DISTINCT (user_id, day)) / 30.0::DOUBLE AS months FROM scored)"


def _curve(spark, d):
    s = scored(spark, d)
    return s, events.curve(s, "user_id", "day", "value", events.thresholds(s, "value", N), SPAN)


def _scale(spark, d, s=None):
    """Events and entity-months, in one job."""
    s = scored(spark, d) if s is None else s
    row = events.anticipable(s, "user_id").crossJoin(events.exposure(s, "user_id", "day")).first()  # one row each
    return row["events"], row["entity_months"]


@query("e1_anticipable_events", f"WITH {SCORED} SELECT count(DISTINCT user_id) AS events FROM scored WHERE days_to_failure BETWEEN 7 AND 30")
def e1(spark, d):
    return events.anticipable(scored(spark, d), "user_id")


@query("e2_alert_episodes", f"WITH RECURSIVE {_episode_ctes(_ONE)} SELECT user_id, day, lead::DOUBLE AS days_to_failure, outcome FROM opened")
def e2(spark, d):
    return events.episodes(scored(spark, d), "user_id", "day", "value", TAU, SPAN).select("user_id", "day", "days_to_failure", "outcome")


@query("e3_thresholds", f"WITH {SCORED} {_RANKS}")
def e3(spark, d):
    return spark.createDataFrame([(t,) for t in events.thresholds(scored(spark, d), "value", N)], "tau double")


@query("e4_event_curve", f"{_CURVE} SELECT * FROM c")
def e4(spark, d):
    return _curve(spark, d)[1]


@query("e5_event_pr_auc", f"""{_CURVE}, p AS (SELECT hits / events AS r, max(CASE WHEN alerts > 0 THEN hits / alerts ELSE 0 END) AS p FROM c, ev GROUP BY 1), q AS (SELECT r - lag(r, 1, 0.0::DOUBLE) OVER (ORDER BY r) AS s, max(p) OVER (ORDER BY r DESC ROWS UNBOUNDED PRECEDING) AS b FROM p) SELECT round(sum(s * b), 6) AS pr_auc FROM q""")
def e5(spark, d):
    return events.pr_auc(_curve(spark, d)[1], _scale(spark, d)[0])


@query("e6_point_metrics", f"""WITH RECURSIVE {_episode_ctes(_ONE)}, a AS (SELECT count(*) AS alerts, count(*) FILTER (WHERE outcome = 'hit') AS hits, count(*) FILTER (WHERE outcome = 'late') AS late FROM opened), b AS (SELECT count(DISTINCT user_id) AS events FROM scored WHERE days_to_failure BETWEEN 7 AND 30),
p AS (SELECT *, hits / alerts::DOUBLE AS p, hits / events::DOUBLE AS r FROM a, b) SELECT alerts, hits, late, events, round(p, 6) AS precision, round(r, 6) AS recall, round(1.25 * p * r / (0.25 * p + r), 6) AS f_beta FROM p""")
def e6(spark, d):
    return events.point(scored(spark, d), "user_id", "day", "value", TAU, 0.5, SPAN)


@query("e7_exposure", f"WITH {DAILY} SELECT count(DISTINCT (user_id, day)) / 30.0::DOUBLE AS entity_months FROM daily")
def e7(spark, d):
    return events.exposure(daily(spark, d), "user_id", "day")


_SWEEP = f"""{_CURVE}, g AS (SELECT k, tau, alerts, hits, 1000.0::DOUBLE * ((alerts - hits) + k * (events - hits)) / months AS cost, 1000.0::DOUBLE * k * events / months AS idle FROM c, ev, ex, (SELECT CAST(unnest(range(1, 51)) AS INTEGER) AS k)),
w AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY k ORDER BY cost, tau DESC) = 1),
sw AS (SELECT k, CASE WHEN cost < idle THEN tau ELSE 'Infinity'::DOUBLE END AS tau, round(CASE WHEN cost < idle THEN cost ELSE idle END, 4) AS cost, CASE WHEN cost < idle THEN alerts ELSE 0 END::BIGINT AS alerts, CASE WHEN cost < idle THEN hits ELSE 0 END::BIGINT AS hits, round(idle, 4) AS cost_without_model FROM w)"""


@query("e9_cost_sweep", f"{_SWEEP} SELECT * FROM sw")
def e9(spark, d):
    return cost.sweep(_curve(spark, d)[1], *_scale(spark, d))


@query("e11_break_even", f"{_SWEEP} SELECT min(k) AS break_even_k FROM sw WHERE cost < cost_without_model - 100")
def e11(spark, d):
    swept = cost.sweep(_curve(spark, d)[1], *_scale(spark, d))
    return cost.break_even(swept, swept.select("k", (F.col("cost_without_model") - 100).alias("cost")))


@query("e12_alert_budget", f"{_CURVE} SELECT tau, alerts::BIGINT AS alerts, round(1000.0 * alerts / months, 4) AS rate FROM c, ex WHERE 1000.0 * alerts / months <= 1500 + 1e-9 ORDER BY rate DESC, tau DESC LIMIT 1")
def e12(spark, d):
    return cost.threshold_for_budget(_curve(spark, d)[1], _scale(spark, d)[1], 1500.0)


@query("e13_budgets_by_k", f"{_SWEEP} SELECT k, round(1000.0 * alerts / months, 4)::DOUBLE AS budget FROM sw, ex")
def e13(spark, d):
    n, months = _scale(spark, d)
    return cost.budgets_by_k(cost.sweep(_curve(spark, d)[1], n, months), months)


@query("e19_lead_times", f"""WITH {SCORED}, f AS (SELECT user_id, arg_min(days_to_failure, day) FILTER (WHERE value >= {TAU}) AS lead_1, min(day) AS fd FROM scored WHERE value >= {TAU} GROUP BY 1),
g AS (SELECT s.days_to_failure AS lead FROM f JOIN scored s ON s.user_id = f.user_id AND s.day = f.fd)
SELECT quantile_cont(lead, 0.5) AS median_lead, count(*) FILTER (WHERE lead > 30) AS early, count(*) FILTER (WHERE lead BETWEEN 7 AND 30) AS in_window, count(*) FILTER (WHERE lead BETWEEN 1 AND 6) AS late, count(*) FILTER (WHERE lead IS NULL OR lead < 1) AS none_ahead FROM g""")
def e19(spark, d):
    return events.lead_times(scored(spark, d), "user_id", "day", "value", TAU)


_DOCS = "s AS (SELECT n_chars AS s, sum(quality) AS pos, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1), c AS (SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS seen, sum(pos) OVER () AS ap, sum(n) OVER () AS an FROM s WINDOW w AS (ORDER BY s DESC ROWS UNBOUNDED PRECEDING))"


def _docs(spark, d):
    return read(spark, d, "documents").select("doc_id", "n_chars").join(read(spark, d, "labels"), "doc_id")


@query("e14_average_precision", f"WITH {_DOCS} SELECT round(sum(pos / ap::DOUBLE * tp / seen), 6) AS average_precision FROM c")
def e14(spark, d):
    return metrics.average_precision(_docs(spark, d), "n_chars", "quality")


@query("e15_pr_auc_trapezoid", f"WITH {_DOCS}, q AS (SELECT s, tp / seen::DOUBLE AS p, tp / ap::DOUBLE AS r FROM c) SELECT round(sum(a), 6) AS pr_auc FROM (SELECT (r - lag(r, 1, 0.0::DOUBLE) OVER (ORDER BY s DESC)) * (p + lag(p, 1, 1.0::DOUBLE) OVER (ORDER BY s DESC)) / 2 AS a FROM q)")
def e15(spark, d):
    return metrics.pr_auc_trapezoid(_docs(spark, d), "n_chars", "quality")


@query("e15_at_threshold", "WITH q AS (SELECT count(*) FILTER (WHERE n_chars >= 2000 AND quality = 1) AS tp, count(*) FILTER (WHERE n_chars >= 2000 AND quality = 0) AS fp, count(*) FILTER (WHERE n_chars < 2000 AND quality = 1) AS fn FROM documents JOIN labels USING (doc_id)) SELECT *, round(tp / (tp + fp)::DOUBLE, 6) AS precision, round(tp / (tp + fn)::DOUBLE, 6) AS recall, round(1.25 * tp / (1.25 * tp + 0.25 * fn + fp), 6)::DOUBLE AS f_beta FROM q")
def e15_at(spark, d):
    return metrics.at_threshold(_docs(spark, d), "n_chars", "quality", 2000)


@query("e16_roc_auc", f"WITH {_DOCS} SELECT round((sum(pos * (an - seen + (n + 1) / 2.0)) - max(ap) * (max(ap) + 1) / 2.0) / (max(ap) * (max(an) - max(ap))), 6)::DOUBLE AS roc_auc FROM c")
def e16(spark, d):
    return metrics.roc_auc(_docs(spark, d), "n_chars", "quality")


@query("e23_overfit_class", "SELECT l_linenumber, CASE WHEN (a - b) / b > 1.0 THEN 'severe' WHEN (a - b) / b > 0.3 THEN 'moderate' ELSE 'ok' END AS overfit FROM (SELECT l_linenumber, sum(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END)::DOUBLE AS a, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END)::DOUBLE AS b FROM lineitem GROUP BY 1)")
def e23(spark, d):
    g = read(spark, d, "lineitem").groupBy("l_linenumber").agg(F.sum(F.when(F.col("l_returnflag") == "N", 1.0).otherwise(0.0)).alias("a"), F.sum(F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0)).alias("b"))
    return g.select("l_linenumber", metrics.overfit_class(F.col("a"), F.col("b")).alias("overfit"))


__all__ = ["epoch_day", "flagship"]


_SKETCHED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_QUANTILES = {"q05": 0.05, "q50": 0.5, "q95": 0.95}
_SKETCH_SQL = " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS row_count, count(*) - count({c}) AS null_count, min({c})::DOUBLE AS low, max({c})::DOUBLE AS high, round(avg({c}), 4) AS mean, true AS distinct_within, true AS q05_within, true AS q50_within, true AS q95_within FROM sparse" for c in _SKETCHED)


@query("a14_sketched_profile", f"WITH {SPARSE} {_SKETCH_SQL}")
def a14_sketched(spark, d):
    """A profile merged from sketches kept by month, of which the last month was added later; the estimates are compared with exact ones."""
    path, l = scratch(spark, "sketches"), sparse_lines(spark, d)
    last = l.agg(F.trunc(F.max("l_shipdate"), "month")).first()[0]
    sketches.append(l.where(F.trunc("l_shipdate", "month") < F.lit(last)), path, "l_shipdate", _SKETCHED)
    sketches.append(l.where(F.trunc("l_shipdate", "month") == F.lit(last)), path, "l_shipdate", _SKETCHED)
    p = cut(sketches.profile(sketches.merged(sketches.stored(spark, path)), _QUANTILES))
    long = l.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("v")) for c in _SKETCHED]))).where("v IS NOT NULL")
    up = [e for n in _QUANTILES for e in (F.avg((F.col("v") <= F.col(n)).cast("int")).alias(f"{n}_upto"), F.avg((F.col("v") < F.col(n)).cast("int")).alias(f"{n}_below"))]
    exact = long.join(F.broadcast(p.select("column_name", *_QUANTILES)), "column_name").groupBy("column_name").agg(F.count_distinct("v").alias("n"), *up)  # a row a column
    within = [((F.col(f"{n}_below") <= q + sketches.RANK_ERROR) & (F.col(f"{n}_upto") >= q - sketches.RANK_ERROR)).alias(f"{n}_within") for n, q in _QUANTILES.items()]
    near = (F.abs(F.col("n_unique") - F.col("n")) <= F.ceil(sketches.DISTINCT_ERROR * F.col("n"))).alias("distinct_within")
    return p.join(exact, "column_name").select("column_name", "row_count", "null_count", "low", "high", F.round("mean", 4).alias("mean"), near, *within)


@query("d12_sketched_scores", """WITH e AS (SELECT CAST(ts AS DATE) AS day, value FROM events), r AS (SELECT day, count(*) AS n FROM e WHERE value IS NOT NULL GROUP BY 1)
SELECT day, n, true AS within FROM r WHERE day >= (SELECT max(day) FROM e) - 6""")
def d12_sketched(spark, d):
    """Percentile scores of the last week against sketches of all months: the greatest error of a day's scores lies within the bound."""
    e = read(spark, d, "events").select(F.to_date("ts").alias("day"), "value").where("value IS NOT NULL")
    all_months = sketches.merged(sketches.monthly(e, "day", ["value"]))
    week = e.where(F.col("day") >= F.date_sub(F.lit(e.agg(F.max("day")).first()[0]), 6))
    counts = running_sums(e.groupBy("value").agg(F.count("*").alias("k")), "value", {"upto": "k"}).select("value", (F.col("upto") / F.col("upto_all")).alias("exact"))
    rows = sketches.with_score(week, "value", sketches.grid(all_months, "value", 500))
    return rows.join(counts, "value").groupBy("day").agg(F.count("*").alias("n"), (F.max(F.abs(F.col("score") - F.col("exact"))) <= sketches.RANK_ERROR + 1 / 500).alias("within"))
