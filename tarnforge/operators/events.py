"""Event-level evaluation: alert episodes, curves, interpolated area, operating points.

An episode is anchored at its opener: the first alert at or after the end of the last silence opens
one and silences the entity for the episode's days. That is no session window, which every
event would extend.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnforge.constants import EPISODE_DAYS, HORIZON_DAYS, MIN_LEAD
from tarnforge.functions.lineage import cut
from tarnforge.operators.ranks import running_sums

LEAD = "days_to_failure"


def anticipable(df: DataFrame, key: str, low: int = MIN_LEAD, high: int = HORIZON_DAYS) -> DataFrame:
    """Entities observed at some time from low to high days before their failure."""
    return df.agg(F.count_distinct(F.when(F.col(LEAD).between(low, high), F.col(key))).alias("events"))


def _prepared(df: DataFrame, key: str, day: str, score: str, weight: str | None, by: list[str] | None = None) -> DataFrame:
    """Days of an entity in order. Rows of a day are first joined to one, of the highest score: only the
    first of them can open an episode. So an entity's array is bounded by its days, however many
    rows a hot entity has."""
    s, by = F.col(score).cast("double"), by or []
    known = df.where(s.isNotNull() & ~F.isnan(s))
    w = F.max(F.col(weight).cast("double")) if weight else F.lit(1.0)
    days = known.groupBy(*by, key, F.col(day).cast("int").alias("_day")).agg(F.max(s).alias("_score"), F.max_by(F.col(LEAD).cast("double"), s).alias("_lead"), w.alias("_weight"))
    rows = F.struct(F.col("_day").alias("day"), F.col("_score").alias("score"), F.col("_lead").alias("lead"))
    return days.groupBy(*by, key).agg(F.sort_array(F.collect_list(rows)).alias("rows"), F.max("_weight").alias("weight"))


def _openers(rows: Column, tau, duration: int | None) -> Column:
    """Rows that open an episode, by a fold over an entity's rows in day order."""
    none = F.array().cast("array<struct<day:int,score:double,lead:double>>")
    start = F.struct(F.lit(-(2**31)).cast("long").alias("free"), none.alias("out"))
    span = duration if duration is not None else 2**31

    def step(acc: Column, r: Column) -> Column:
        return F.when((r["score"] >= tau) & (r["day"] >= acc["free"]), F.struct((r["day"].cast("long") + span).alias("free"), F.concat(acc["out"], F.array(r)).alias("out"))).otherwise(acc)

    return F.aggregate(rows, start, step, lambda a: a["out"])


def episodes(df: DataFrame, key: str, day: str, score: str, tau: float, duration: int | None = EPISODE_DAYS, weight: str | None = None) -> DataFrame:
    """One row an episode: entity, day, lead, outcome (hit, late, false_alarm), weight. Rows below tau
    are filtered before they are gathered."""
    p = _prepared(df.where(F.col(score) >= tau), key, day, score, weight)
    e = p.select(key, "weight", F.explode(_openers(F.col("rows"), F.lit(tau), duration)).alias("r"))
    lead = F.col("r.lead")
    outcome = F.when(lead.between(MIN_LEAD, HORIZON_DAYS), "hit").when((lead >= 1) & (lead < MIN_LEAD), "late").otherwise("false_alarm")
    return e.select(key, F.col("r.day").alias("day"), lead.alias(LEAD), outcome.alias("outcome"), "weight")


def point(df: DataFrame, key: str, day: str, score: str, tau: float, beta: float = 0.5, duration: int | None = EPISODE_DAYS) -> DataFrame:
    """alerts, hits, late, events, precision, recall, F-beta at one threshold; 0 where undefined."""
    e = episodes(df, key, day, score, tau, duration).agg(*[F.count_if(F.lit(True) if o is None else F.col("outcome") == o).alias(n) for n, o in (("alerts", None), ("hits", "hit"), ("late", "late"))])
    j = e.crossJoin(anticipable(df, key))
    p, r = F.when(F.col("alerts") > 0, F.col("hits") / F.col("alerts")).otherwise(0.0), F.when(F.col("events") > 0, F.col("hits") / F.col("events")).otherwise(0.0)
    b2 = beta * beta
    j = j.withColumn("precision", p).withColumn("recall", r)
    f = F.when(F.col("precision") + F.col("recall") > 0, (1 + b2) * F.col("precision") * F.col("recall") / (b2 * F.col("precision") + F.col("recall"))).otherwise(0.0)
    return j.withColumn("f_beta", f).withColumns({c: F.round(c, 6) for c in ("precision", "recall")}).withColumn("f_beta", F.round("f_beta", 6))


def _known_scores(df: DataFrame, score: str) -> DataFrame:
    s = F.col(score).cast("double")
    return df.where(s.isNotNull() & ~F.isnan(s) & (F.abs(s) < float("inf")))


def _log_ranks(total: int, n: int) -> list[int]:
    """n ranks from the first to the last at equal steps of their logarithm, without repeats."""
    return sorted({int(x) for x in np.round(np.logspace(0, np.log10(total), n))}) if total else []


def thresholds_by(df: DataFrame, by: str, score: str, n: int = 400) -> dict:
    """Of each group descending thresholds at log-spaced ranks of the finite scores. Ranks are found in the
    counts of distinct scores, in one order of (group, score); at most n values a group come to the driver."""
    counted = _known_scores(df, score).groupBy(F.struct(F.col(by).alias("by"), F.col(score).cast("double").alias("s")).alias("at")).agg(F.count("*").alias("k"))
    summed = running_sums(counted, "at", {"hi": "k"}, descending=True)
    groups = {r["by"]: (r["first"], r["total"]) for r in summed.groupBy(F.col("at.by").alias("by")).agg(F.min(F.col("hi") - F.col("k")).alias("first"), F.sum("k").alias("total")).collect()}
    if not groups:
        return {}
    ranks = F.create_map(*[x for g, (first, total) in groups.items() for x in (F.lit(g), F.array(*[F.lit(first + r) for r in _log_ranks(total, n)]))])
    hit = F.exists(ranks[F.col("at.by")], lambda r: (r > F.col("hi") - F.col("k")) & (r <= F.col("hi")))
    out: dict = {g: [] for g in groups}
    for r in summed.where(hit).select("at.by", "at.s").collect():
        out[r["by"]].append(r["s"])
    return {g: sorted(t, reverse=True) for g, t in out.items()}


def thresholds(df: DataFrame, score: str, n: int = 400) -> list[float]:
    """Descending thresholds at log-spaced ranks of the finite scores."""
    return thresholds_by(df.select(F.col(score), F.lit("").alias("_all")), "_all", score, n).get("", [])


def episode_openers(entity: np.ndarray, day: np.ndarray, span: int) -> np.ndarray:
    """Which alerts open an episode, of alerts in the order of (entity, day).

    The next opener after an opener is the first alert of the entity ``span`` or more days later: a pointer that
    one sorted search finds for all alerts. From each entity's first alert the openers are reached by doubling: the
    reached set grows by the pointers' targets, then each pointer takes its target's, log n times.
    """
    n = len(day)
    if not n:
        return np.zeros(0, dtype=bool)
    first = np.concatenate([[True], entity[1:] != entity[:-1]])
    low = day.min()
    width = int(day.max() - low) + 1
    at = (np.cumsum(first) - 1) * (width + 1) + (day - low)  # entities one after the other, a day apart
    end = np.append(np.flatnonzero(first)[1:], n)[np.cumsum(first) - 1]
    jump = np.minimum(np.searchsorted(at, at + min(span, width)), end)
    jump = np.append(np.where(jump < end, jump, n), n)  # place n: nothing follows
    reached = np.append(first, False)
    live = np.flatnonzero(reached)
    while True:
        new = jump[live]
        new = new[new < n]
        new = new[~reached[new]]
        if not len(new):
            return reached[:n]
        reached[new] = True
        jump = jump[jump]
        live = np.flatnonzero(reached)


def _count_episodes(rows, weights: list[float], levels: np.ndarray, span: int) -> np.ndarray:
    """Alerts, hits and late ones by level, of a list array of entities' days, each level for all entities at once."""
    total = np.zeros((len(levels), 3))
    flat, size = rows.flatten(), rows.value_lengths().to_numpy(zero_copy_only=False)
    entity = np.repeat(np.arange(len(size)), size)
    day, score = flat.field("day").to_numpy(zero_copy_only=False).astype(np.int64), flat.field("score").to_numpy(zero_copy_only=False)
    lead = flat.field("lead").to_numpy(zero_copy_only=False).astype(float)  # null: nan
    kind = np.where((lead >= MIN_LEAD) & (lead <= HORIZON_DAYS), 1, np.where((lead >= 1) & (lead < MIN_LEAD), 2, 0))
    weight = np.asarray(weights, dtype=float)[entity] if len(entity) else np.zeros(0)
    # Alerts of a level are alerts of all lower ones: from the lowest on, rows only go.
    live = np.arange(len(day))
    for k in np.argsort(levels, kind="stable"):
        live = live[score[live] >= levels[k]]
        if not len(live):
            break
        opened = live[episode_openers(entity[live], day[live], span)]
        total[k] = weight[opened].sum(), weight[opened[kind[opened] == 1]].sum(), weight[opened[kind[opened] == 2]].sum()
    return total


def curve_by(df: DataFrame, by: str, key: str, day: str, score: str, taus: dict, duration: int | None = EPISODE_DAYS, weight: str | None = None) -> DataFrame:
    """``by``, tau, alerts, hits, late for each group and its thresholds. Parallel over entities, with all
    thresholds inside: an Arrow function runs over each batch of entities' arrays and its sums are
    pre-aggregated. Days below a group's lowest threshold are dropped before."""
    import pyarrow as pa

    span = duration if duration is not None else 2**40
    levels = {g: np.asarray(t, dtype=float) for g, t in taus.items()}

    def run(batches):
        total = {g: np.zeros((len(t), 3)) for g, t in levels.items()}
        for b in batches:
            groups = b.column(0).to_pylist()
            for g in dict.fromkeys(groups):
                own = b.filter(pa.array([x == g for x in groups])) if len(total) > 1 else b
                if g in total:
                    total[g] += _count_episodes(own.column(1), own.column(2).to_pylist(), levels[g], span)
        for g, t in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([g] * len(t), kind), pa.array(levels[g]), *[pa.array(t[:, k].copy()) for k in range(3)]], ["by", "tau", "alerts", "hits", "late"])

    from pyspark.sql.pandas.types import to_arrow_type

    spark_kind = df.schema[by].dataType
    kind = to_arrow_type(spark_kind)
    known = [g for g, t in taus.items() if t]
    lowest = F.create_map(*[F.lit(x) for g in known for x in (g, float(min(taus[g])))]) if known else F.create_map(F.lit("").cast(spark_kind), F.lit(0.0))
    p = _prepared(df.where(F.col(score).cast("double") >= lowest[F.col(by)]), key, day, score, weight, [by]).select(by, "rows", "weight")
    out = p.mapInArrow(run, f"by {spark_kind.simpleString()}, tau double, alerts double, hits double, late double").groupBy("by", "tau").agg(*[F.sum(c).alias(c) for c in ("alerts", "hits", "late")])
    return out.withColumnRenamed("by", by)


def curve(df: DataFrame, key: str, day: str, score: str, taus: list[float], duration: int | None = EPISODE_DAYS, weight: str | None = None) -> DataFrame:
    """tau, alerts, hits, late for each threshold."""
    return curve_by(df.withColumn("_all", F.lit("")), "_all", key, day, score, {"": taus}, duration, weight).drop("_all")


def pr_auc_by(curve_df: DataFrame, by: list[str], events: int) -> DataFrame:
    """Area with interpolated precision: at each recall the best precision at that recall or above.
    Null without events or thresholds. A group's curve has as many rows as thresholds."""
    p = F.when(F.col("alerts") > 0, F.col("hits") / F.col("alerts")).otherwise(0.0)
    c = curve_df.select(*by, (F.col("hits") / F.lit(float(events) if events else None)).alias("r"), p.alias("p"))
    c = c.where("r IS NOT NULL").groupBy(*by, "r").agg(F.max("p").alias("p"))
    w = Window.partitionBy(*by)
    best = F.max("p").over(w.orderBy(F.desc("r")).rowsBetween(Window.unboundedPreceding, 0))
    step = F.col("r") - F.coalesce(F.lag("r").over(w.orderBy("r")), F.lit(0.0))
    return c.select(*by, step.alias("d"), best.alias("b")).groupBy(*by).agg(F.round(F.sum(F.col("d") * F.col("b")), 6).alias("pr_auc"))


def pr_auc(curve_df: DataFrame, events: int) -> DataFrame:
    return pr_auc_by(curve_df, [], events)


def exposure(df: DataFrame, key: str, day: str) -> DataFrame:
    """Entity-months: distinct entity days by 30."""
    return df.agg((F.count_distinct(key, day) / 30.0).alias("entity_months"))


def first_alerts(df: DataFrame, key: str, day: str, score: str, tau: float) -> DataFrame:
    """First alert of each entity with its lead and class: early, in_window, late, none_ahead."""
    a = df.where(F.col(score) >= tau).groupBy(key).agg(F.min_by(F.struct(day, LEAD), day).alias("f"))
    lead = F.col("f")[LEAD]
    kind = F.when(lead > HORIZON_DAYS, "early").when(lead >= MIN_LEAD, "in_window").when(lead >= 1, "late").otherwise("none_ahead")
    return a.select(key, F.col("f")[day].alias("first_day"), lead.alias(LEAD), kind.alias("alert_class"))


def lead_times(df: DataFrame, key: str, day: str, score: str, tau: float) -> DataFrame:
    a = first_alerts(df, key, day, score, tau)
    return a.agg(F.percentile(LEAD, 0.5).alias("median_lead"), *[F.count_if(F.col("alert_class") == c).alias(c) for c in ("early", "in_window", "late", "none_ahead")])


def univariate_auc(df: DataFrame, key: str, day: str, cols: list[str], n: int = 100, duration: int | None = EPISODE_DAYS) -> DataFrame:
    """column_name, sign, pr_auc, lift: the area of each column in both signs, and its lift over random
    alarms. The columns are unpivoted once, and all curves are made in one pass."""
    one = df.agg(F.count_distinct(F.when(F.col(LEAD).between(MIN_LEAD, HORIZON_DAYS), F.col(key))).alias("events"), F.avg(F.when(F.col(LEAD).between(MIN_LEAD, HORIZON_DAYS), 1.0).otherwise(0.0)).alias("base")).first()
    parts = F.array(*[F.struct(F.lit(f"{sign:+d}|{c}").alias("side"), (sign * F.col(c).cast("double")).alias("s")) for c in cols for sign in (1, -1)])
    long = cut(df.select(key, day, LEAD, F.inline(parts)).where("s IS NOT NULL"))
    areas = pr_auc_by(curve_by(long, "side", key, day, "s", thresholds_by(long, "side", "s", n), duration), ["side"], one["events"])
    sides = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(f"{sign:+d}|{c}") for c in cols for sign in (1, -1)])).alias("side"))
    out = sides.join(areas, "side", "left")
    return out.select(F.expr("substr(side, 4)").alias("column_name"), F.expr("CAST(substr(side, 1, 2) AS int)").alias("sign"), "pr_auc", (F.col("pr_auc") / F.nullif(F.lit(one["base"]).cast("double"), F.lit(0.0))).alias("lift"))
