"""Queries of budgets on other rows, univariate areas, samples, searches and the wide table's contract."""

from __future__ import annotations

import tempfile

from pyspark.sql import functions as F

from tarnforge.catalog.analytics import N, SPAN, _docs, _scale
from tarnforge.catalog.base import DAILY, FAILED, SCORED, daily, query, read, scored, scratch
from tarnforge.catalog.wide import SPEC, _facts
from tarnforge.operators import cost, events, metrics, models, sampling, splits, windows
from tarnforge.plans import wide_table

# ---- event evaluation


def _curve_ctes(x: str, value: str = "value", where: str = "true") -> str:
    """Thresholds, episodes, curve, events and months of one score over some of the scored rows."""
    return f"""s{x} AS (SELECT user_id, day, CAST({value} AS DOUBLE) AS value, days_to_failure FROM scored WHERE {where}),
t{x} AS (SELECT DISTINCT v AS tau FROM (SELECT value AS v, row_number() OVER (ORDER BY value DESC) AS r FROM s{x}) WHERE r IN (SELECT CAST(round_even(pow(10, i * log10((SELECT count(*) FROM s{x})) / {N - 1}), 0) AS BIGINT) FROM range({N}) t(i))),
h{x} AS (SELECT t.tau, user_id, day, days_to_failure AS lead FROM s{x} s, t{x} t WHERE s.value >= t.tau),
n{x} AS (SELECT a.tau, a.user_id, a.day, min(b.day) AS nd FROM h{x} a LEFT JOIN h{x} b ON a.tau = b.tau AND a.user_id = b.user_id AND b.day >= a.day + {SPAN} GROUP BY 1, 2, 3),
e{x} AS (SELECT tau, user_id, min(day) AS day FROM h{x} GROUP BY 1, 2 UNION ALL SELECT n.tau, n.user_id, n.nd FROM e{x} e JOIN n{x} n ON n.tau = e.tau AND n.user_id = e.user_id AND n.day = e.day WHERE n.nd IS NOT NULL),
c{x} AS (SELECT tau, count(*)::DOUBLE AS alerts, count(*) FILTER (WHERE lead BETWEEN 7 AND 30)::DOUBLE AS hits, count(*) FILTER (WHERE lead >= 1 AND lead < 7)::DOUBLE AS late FROM e{x} JOIN h{x} USING (tau, user_id, day) GROUP BY 1),
v{x} AS (SELECT count(DISTINCT user_id) FILTER (WHERE days_to_failure BETWEEN 7 AND 30) AS events, count(DISTINCT (user_id, day)) / 30.0::DOUBLE AS months FROM s{x})"""


_TRAIN, _TEST = "d < DATE '2024-01-18'", "d >= DATE '2024-01-18'"


@query("e13_cost_at_budget", f"""WITH RECURSIVE {SCORED}, {_curve_ctes('a', where=_TRAIN)}, {_curve_ctes('b', where=_TEST)},
g AS (SELECT k, tau, alerts, 1000.0::DOUBLE * ((alerts - hits) + k * (events - hits)) / months AS cost, 1000.0::DOUBLE * k * events / months AS idle, 1000.0 * alerts / months AS rate FROM ca, va, (SELECT CAST(unnest([1, 10, 25, 50]) AS INTEGER) AS k)),
w AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY k ORDER BY cost, tau DESC) = 1),
p AS (SELECT k, round(CASE WHEN cost < idle THEN rate ELSE 0 END, 4)::DOUBLE AS budget FROM w),
f AS (SELECT p.k, p.budget, cb.*, 1000.0 * alerts / months AS rate FROM p, cb, vb WHERE budget > 0 AND 1000.0 * alerts / months <= budget + 1e-9 QUALIFY row_number() OVER (PARTITION BY p.k ORDER BY 1000.0 * alerts / months DESC, tau DESC) = 1)
SELECT p.k, p.budget, coalesce(tau, 'Infinity'::DOUBLE) AS tau, coalesce(alerts, 0)::BIGINT AS alerts, coalesce(hits, 0)::BIGINT AS hits, coalesce(late, 0)::BIGINT AS late, coalesce(round(rate, 4), 0)::DOUBLE AS rate,
  round(1000.0::DOUBLE * (coalesce(alerts - hits, 0) + p.k * (events - coalesce(hits, 0))) / months, 4) AS cost, round(1000.0::DOUBLE * p.k * events / months, 4) AS cost_without_model FROM p LEFT JOIN f USING (k), vb""")
def e13_cost(spark, d):
    """Budgets chosen on the first days, their cost on the last ones."""
    s = scored(spark, d)
    train, test = s.where(_TRAIN), s.where(_TEST)
    n, months = _scale(spark, d, train)
    swept = cost.sweep(events.curve(train, "user_id", "day", "value", events.thresholds(train, "value", N), SPAN), n, months, ks=(1, 10, 25, 50))
    n, later = _scale(spark, d, test)
    return cost.cost_at_budget(events.curve(test, "user_id", "day", "value", events.thresholds(test, "value", N), SPAN), n, later, cost.budgets_by_k(swept, months))


def _at_budget(x: str, model: str) -> str:
    return f"""SELECT * FROM (SELECT '{model}' AS model, alerts::BIGINT AS alerts, hits::BIGINT AS hits, late::BIGINT AS late, events, round(hits / alerts, 6) AS precision, round(hits / events, 6) AS recall, tau
FROM c{x}, v{x} WHERE 1000.0 * alerts / months <= 1500 + 1e-9 ORDER BY 1000.0 * alerts / months DESC, tau DESC LIMIT 1)"""


@query("e18_same_budget", f"WITH RECURSIVE {SCORED}, {_curve_ctes('a')}, {_curve_ctes('b', '100 - value')} {_at_budget('a', 'value')} UNION ALL {_at_budget('b', 'inverse')}")
def e18(spark, d):
    s = scored(spark, d)
    rows = cost.same_budget({"value": s, "inverse": s.withColumn("value", 100 - F.col("value"))}, "user_id", "day", "value", 1500.0, N, SPAN)
    names = ("model", "alerts", "hits", "late", "events", "precision", "recall", "tau")
    return spark.createDataFrame([tuple(r[c] for c in names) for r in rows], "model string, alerts long, hits long, late long, events long, precision double, recall double, tau double")


def _area(x: str, column: str, sign: int) -> str:
    return f"""SELECT '{column}' AS column_name, {sign} AS sign, round(sum(s * b), 6) AS pr_auc FROM (SELECT r - lag(r, 1, 0.0::DOUBLE) OVER (ORDER BY r) AS s, max(p) OVER (ORDER BY r DESC ROWS UNBOUNDED PRECEDING) AS b
FROM (SELECT hits / events AS r, max(CASE WHEN alerts > 0 THEN hits / alerts ELSE 0 END) AS p FROM c{x}, v{x} GROUP BY 1))"""


_SIDES = {"a": ("value", 1), "b": ("value", -1), "f": ("n", 1), "g": ("n", -1)}


@query("e21_univariate_area", f"""WITH RECURSIVE {SCORED}, {', '.join(_curve_ctes(x, f'{sign} * {c}') for x, (c, sign) in _SIDES.items())}, areas AS ({' UNION ALL '.join(_area(x, *side) for x, side in _SIDES.items())})
SELECT column_name, sign, pr_auc, round(pr_auc / (SELECT avg(CASE WHEN days_to_failure BETWEEN 7 AND 30 THEN 1.0 ELSE 0.0 END) FROM scored), 4) AS lift FROM areas""")
def e21(spark, d):
    """Area of the event curve of each sign of two columns, with its lift over random alarms."""
    out = events.univariate_auc(scored(spark, d), "user_id", "day", ["value", "n"], N, SPAN)
    return out.withColumn("lift", F.round("lift", 4))


_FOLDS = """e AS (SELECT date_trunc('month', max(o_orderdate)) + INTERVAL 1 MONTH AS e FROM orders), f AS (SELECT i AS fold, CAST(e - to_months(CAST((4 - i) * 2 AS INTEGER)) AS DATE) AS a FROM e, range(4) t(i)),
r AS (SELECT fold, avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) FILTER (WHERE CAST(o_orderdate AS DATE) < a - 30) AS rate FROM f, orders GROUP BY 1)"""


@query("e22_fold_evaluation", f"WITH {_FOLDS} SELECT fold, round(rate, 6)::DOUBLE AS fold_value, round(avg(rate) OVER (), 6)::DOUBLE AS mean_value, round(stddev_samp(rate) OVER (), 6)::DOUBLE AS std_value FROM r")
def e22(spark, d):
    """The prior of each fold's training rows, seen on its validation rows."""
    o = read(spark, d, "orders").select(F.to_date("o_orderdate").alias("day"), F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("y"))
    got = models.evaluate_folds(o, "day", splits.embargo_folds(o, "day"), models.Prior, [], "y", lambda x: x.agg(F.avg("score")).first()[0])
    rows = [(i, round(v, 6), round(got["mean"], 6), round(got["std"], 6)) for i, v in enumerate(got["values"])]
    return spark.createDataFrame(rows, "fold long, fold_value double, mean_value double, std_value double")


_F_BETA = "SELECT tau, 1.25 * count(*) FILTER (WHERE n_chars >= tau AND quality = 1) / (1.25 * count(*) FILTER (WHERE n_chars >= tau AND quality = 1) + 0.25 * count(*) FILTER (WHERE n_chars < tau AND quality = 1) + count(*) FILTER (WHERE n_chars >= tau AND quality = 0)) AS f FROM documents JOIN labels USING (doc_id), (SELECT unnest([500, 1000, 2000, 4000]) AS tau) GROUP BY 1"


@query("ml9_search", f"SELECT tau, round(f, 6)::DOUBLE AS f_beta, 4 AS tried, 0 AS tried_again FROM ({_F_BETA}) ORDER BY f DESC LIMIT 1")
def ml9(spark, d):
    """A search over thresholds; a second search finds all its points in the log."""
    docs, tried = _docs(spark, d).cache(), []

    def evaluate(point, prune):
        tried.append(point)
        value = metrics.at_threshold(docs, "n_chars", "quality", point["tau"]).first()["f_beta"]
        prune(0, value)
        return {"mean": value}

    with tempfile.TemporaryDirectory() as folder:
        space, counts = [{"tau": t} for t in (500, 1000, 2000, 4000)], []
        for _ in range(2):
            best = models.search(space, evaluate, models.RunLog(folder), "threshold")
            counts.append(len(tried) - sum(counts))
    docs.unpersist()
    return spark.createDataFrame([(best["point"]["tau"], best["mean"], *counts)], "tau int, f_beta double, tried int, tried_again int")


@query("ml10_run_log", "SELECT round(avg(quality), 6)::DOUBLE AS rate, true AS reproduced, false AS another_value FROM labels")
def ml10(spark, d):
    """A run is logged under an alias and reproduced from it."""
    rate = read(spark, d, "labels").agg(F.round(F.avg("quality"), 6)).first()[0]
    with tempfile.TemporaryDirectory() as folder:
        log = models.RunLog(folder)
        log.alias("champion", log.log({"model": "prior"}, {"rate": rate}))
        row = (log.load("champion")["metrics"]["rate"], log.reproduces("champion", "rate", rate), log.reproduces("champion", "rate", rate + 0.01))
    return spark.createDataFrame([row], "rate double, reproduced boolean, another_value boolean")


@query("ml6_stratified_subsample", "WITH o AS (SELECT o_orderkey, o_orderstatus, count(*) OVER (PARTITION BY o_orderstatus) AS k, count(*) OVER () AS n, row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5(CAST(o_orderkey AS VARCHAR) || '|4')) AS place FROM orders) SELECT o_orderkey, o_orderstatus FROM o WHERE place <= greatest(1, 500 * k // n)")
def ml6(spark, d):
    return sampling.stratified_subsample(read(spark, d, "orders"), "o_orderstatus", F.col("o_orderkey"), 500, "4").select("o_orderkey", "o_orderstatus")


@query("ml7_prompt_cases", f"WITH {DAILY}, r AS (SELECT user_id, d, n, value, avg(value) OVER (PARTITION BY user_id ORDER BY day RANGE BETWEEN 6 PRECEDING AND CURRENT ROW) AS m FROM daily) SELECT user_id, d, to_json(struct_pack(age_days := round(n::DOUBLE, 3), value := struct_pack(now := round(value + 1e-7, 3), mean_7 := round(m + 1e-7, 3)))) AS prompt_case FROM r")
def ml7(spark, d):
    r = windows.rolling(daily(spark, d), "user_id", "day", ["value"], (7,)).withColumns({c: F.col(c) + 1e-7 for c in ("value", "value_MEAN_7D")})
    return models.prompt_cases(r, "n", ["value"], {"now": "", "mean_7": "_MEAN_7D"}).select("user_id", "d", F.col("prompt_case").cast("string").alias("prompt_case"))


# ---- samples and orders


@query("w13_sample_per_group", "SELECT o_orderpriority, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5(CAST(o_orderkey AS VARCHAR) || '|6')) <= 20")
def w13(spark, d):
    return sampling.sample_per_group(read(spark, d, "orders"), ["o_orderpriority"], F.col("o_orderkey"), 20, "6").select("o_orderpriority", "o_orderkey")


@query("bernoulli_share", "SELECT true AS near_a_fifth, true AS repeatable FROM (SELECT count(*) FROM lineitem)")
def bernoulli(spark, d):
    """Each row by itself with a chance of 20 %: the share is near it, and the same for the same seed."""
    l = read(spark, d, "lineitem")
    n, one, two = l.count(), *[sampling.bernoulli(l, 20, 7).count() for _ in range(2)]
    return spark.createDataFrame([(abs(one - 0.2 * n) < 5 * (0.16 * n) ** 0.5, one == two)], "near_a_fifth boolean, repeatable boolean")


@query("w14_offset_period", f"WITH {DAILY} SELECT a.user_id, a.d, round(avg(b.value) + 1e-7, 4) AS previous_mean, count(b.value) AS previous_count FROM daily a LEFT JOIN daily b ON b.user_id = a.user_id AND b.d BETWEEN a.d - 13 AND a.d - 7 GROUP BY 1, 2")
def w14(spark, d):
    """The period before the window, recomputed by the oracle as a join of all pairs of days."""
    r = windows.rolling(daily(spark, d), "user_id", "day", ["value"], (7,))
    return r.select("user_id", "d", F.round(F.col("value_PREV_MEAN_7D") + 1e-7, 4).alias("previous_mean"), F.col("value_PREV_COUNT_7D").alias("previous_count"))


@query("d19_capped_rows", f"WITH {SCORED}, z AS (SELECT CAST(round(300.0::DOUBLE / count(*) * 10000) AS INTEGER) AS b, count(*) / 300.0::DOUBLE AS w FROM scored), e AS (SELECT user_id, max(CASE WHEN days_to_failure BETWEEN 1 AND 7 THEN 1 ELSE 0 END) AS pos FROM scored GROUP BY 1) SELECT s.user_id, s.d, round(CASE WHEN pos = 1 THEN 1.0::DOUBLE ELSE w END, 6) AS weight FROM scored s JOIN e USING (user_id), z WHERE pos = 1 OR (('0x' || substr(md5(CAST(user_id AS VARCHAR) || '2'), 1, 8))::BIGINT % 10000) < b")
def d19(spark, d):
    s = sampling.cap_rows(scored(spark, d), "user_id", F.col("days_to_failure").between(1, 7), 300, "2")
    return s.select("user_id", "d", F.round("weight", 6).alias("weight"))


@query("o6_entity_day_order", f"WITH {DAILY} SELECT count(*) AS n, 0 AS split_entities, 0 AS out_of_order FROM daily")
def o6(spark, d):
    """Entities lie in one partition, and their days in order."""
    rows = windows.lexsort(daily(spark, d), "user_id", "day", 5).select("user_id", "day", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"))
    by = rows.groupBy("user_id").agg(F.count("*").alias("n"), F.count_distinct("part").alias("parts"), F.transform(F.sort_array(F.collect_list(F.struct("at", "day"))), lambda r: r["day"]).alias("days"))
    return by.agg(F.sum("n").alias("n"), F.count_if(F.col("parts") > 1).cast("int").alias("split_entities"), F.count_if(F.col("days") != F.sort_array("days")).cast("int").alias("out_of_order"))


# ---- the wide table


def _feature_sql() -> str:
    value = {f"R_{i}": f"CAST(value * {i % 7 + 1} AS DECIMAL(38, 6))" for i in SPEC.ids} | {f"N_{i}": f"CAST(CASE WHEN n < 4 THEN n + {i % 5} END AS DECIMAL(38, 6))" for i in SPEC.ids}
    parts = []
    for b in SPEC.bases():
        for n in SPEC.windows:
            parts.append(f"""SELECT '{b}' AS base, {n} AS days, count(m) AS means, round(sum(m) + 1e-7, 2) AS mean_total, sum(k)::BIGINT AS counts, sum(pk)::BIGINT AS previous_counts, sum((k > 0)::INT)::BIGINT AS valid, count(CASE WHEN k > 0 AND pk > 0 THEN 1 END) AS shifts,
round(sum(CASE WHEN k > 0 AND pk > 0 THEN m - pm END) + 1e-7, 2) AS shift_total, sum((k > 0 AND pk > 0)::INT)::BIGINT AS shift_valid FROM (SELECT avg({b}::DOUBLE) OVER c AS m, count({b}) OVER c AS k, avg({b}::DOUBLE) OVER p AS pm, count({b}) OVER p AS pk FROM x
WINDOW c AS (PARTITION BY user_id ORDER BY day RANGE BETWEEN {n - 1} PRECEDING AND CURRENT ROW), p AS (PARTITION BY user_id ORDER BY day RANGE BETWEEN {2 * n - 1} PRECEDING AND {n} PRECEDING))""")
    return f"WITH {DAILY}, x AS (SELECT user_id, day, {', '.join(f'{v} AS {b}' for b, v in value.items())} FROM daily) " + " UNION ALL ".join(parts)


@query("obt_feature_values", _feature_sql())
def obt_values(spark, d):
    """Every kind of feature of every attribute and window, summed over all rows."""
    stage = wide_table.build(*_facts(spark, d, SPEC.ids), SPEC)
    each = []
    for b in SPEC.bases():
        for n in SPEC.windows:
            c = lambda part, b=b, n=n: F.col(f"{b}_{part}_{n}D")
            each.append(F.struct(
                F.lit(b).alias("base"), F.lit(n).alias("days"), F.count(c("MEAN")).alias("means"), F.round(F.sum(c("MEAN")) + 1e-7, 2).alias("mean_total"), F.sum(c("COUNT")).alias("counts"), F.sum(c("PREV_COUNT")).alias("previous_counts"),
                F.sum(c("MEAN_VALID")).alias("valid"), F.count(c("MEAN_SHIFT")).alias("shifts"), F.round(F.sum(c("MEAN_SHIFT")) + 1e-7, 2).alias("shift_total"), F.sum(c("MEAN_SHIFT_VALID")).alias("shift_valid"),
            ))
    return stage.agg(F.array(*each).alias("rows")).select(F.inline("rows"))


@query("obt_validated_run", f"""WITH {DAILY}, {FAILED}, seen AS (SELECT user_id, max(d) AS last_seen FROM daily GROUP BY 1), l AS (SELECT y.user_id, y.d, CASE WHEN y.d > f.ff THEN 'POST_FAILURE' WHEN y.d = f.ff THEN 'SAME_DAY_FAILURE' WHEN date_diff('day', y.d, f.ff) BETWEEN 1 AND 30 THEN 'POSITIVE' WHEN date_diff('day', y.d, s.last_seen) >= 30 THEN 'NEGATIVE' ELSE 'CENSORED' END AS st
FROM daily y LEFT JOIN failed f USING (user_id) LEFT JOIN seen s USING (user_id))
SELECT count(*) AS output_rows, count(DISTINCT user_id) AS entities, count(*) FILTER (WHERE st = 'POSITIVE') AS positive_rows, count(*) FILTER (WHERE st = 'NEGATIVE') AS negative_rows, count(*) FILTER (WHERE st = 'CENSORED') AS censored_rows,
  0 AS errors, {len(SPEC.columns())} AS width, {len(SPEC.columns(('R',)))} AS width_of_one, count(*) AS rows_of_one, 'published' AS status FROM l""")
def obt_validated(spark, d):
    """Built, stored, validated, projected, published and audited; what is published is read again."""
    from tarnforge.sources import publish

    root = scratch(spark, "obt")
    facts, failed = _facts(spark, d, SPEC.ids)
    got = wide_table.run(spark, facts, failed, root, "nonce", SPEC)
    whole, one = publish.open_published(spark, root, "obt_rn"), publish.open_published(spark, root, "obt_r")
    status = spark.read.parquet(f"{root}/_audit").first()["status"]
    errors = sum(got[k] for k in ("NULL_IDENTITY", "COUNT_ERRORS", "MEAN_ERRORS", "SHIFT_ERRORS", "LABEL_ERRORS"))
    row = (whole.count(), got["ENTITIES"], got["POSITIVE_ROWS"], got["NEGATIVE_ROWS"], got["CENSORED_ROWS"], errors, len(whole.columns), len(one.columns), one.count(), status)
    return spark.createDataFrame([row], "output_rows long, entities long, positive_rows long, negative_rows long, censored_rows long, errors int, width int, width_of_one int, rows_of_one long, status string")
