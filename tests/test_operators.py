"""Fixtures of hard cases for labels, windows, imputation, merges, reconciliation, keys and events."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnforge import constants
from tarnforge.functions import keys, scalar
from tarnforge.operators import clean, cost, events, impute, joins, labels, merge, metrics, preprocess, profile, quality, sampling, sets, splits, star, windows

DAY = dt.date(2024, 1, 1)


def day(n):
    return DAY + dt.timedelta(days=n)


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_id_lists():
    assert (len(constants.ATTRIBUTE_IDS), len(constants.RETAINED_IDS), len(constants.MODEL_IDS)) == (51, 34, 22)
    assert constants.context_days() == (59, 30)


def test_labels(spark):
    """(observation, failures, last seen) to status and target."""
    cases = {
        "after": (11, [10], 90, "POST_FAILURE", None), "same": (10, [10], 90, "SAME_DAY_FAILURE", None), "one": (9, [10], 90, "POSITIVE", 1), "thirty": (0, [30], 90, "POSITIVE", 1),
        "seen30": (0, [31], 30, "NEGATIVE", 0), "seen29": (0, [31], 29, "CENSORED", None), "healthy30": (0, [], 30, "NEGATIVE", 0), "healthy29": (0, [], 29, "CENSORED", None), "between": (15, [10, 20], 90, "POST_FAILURE", None),
    }
    obs = spark.createDataFrame([(k, day(c[0])) for k, c in cases.items()], "e string, d date")
    seen = spark.createDataFrame([(k, day(c[2])) for k, c in cases.items()], "e string, d date")
    fail = spark.createDataFrame([(k, day(f)) for k, c in cases.items() for f in c[1]], "e string, f date")
    got = {r["e"]: (r["label_status"], r["target"]) for r in rows(labels.label_horizon(obs, fail, "e", "d", "f", context=obs.union(seen)))}
    assert got == {k: c[3:] for k, c in cases.items()}


def test_windows_by_days_with_gaps_and_nulls(spark):
    data = [(1, 2.0), (2, None), (9, 4.0), (14, 8.0), (60, 1.0), (61, 3.0)]
    df = spark.createDataFrame([("a", d, x) for d, x in data] + [("b", 5, None)], "e string, day int, x double")
    got = rows(windows.with_shifts(windows.rolling(df, "e", "day", ["x"]), ["x"]))
    for r in got:
        own = [(d, x) for d, x in (data if r["e"] == "a" else [(5, None)])]
        for n in constants.WINDOW_DAYS:
            now = [x for d, x in own if r["day"] - n < d <= r["day"] and x is not None]
            before = [x for d, x in own if r["day"] - 2 * n < d <= r["day"] - n and x is not None]
            assert (r[f"x_COUNT_{n}D"], r[f"x_PREV_COUNT_{n}D"]) == (len(now), len(before))
            assert r[f"x_MEAN_{n}D"] == (np.mean(now) if now else None)
            assert r[f"x_MEAN_SHIFT_{n}D"] == (np.mean(now) - np.mean(before) if now and before else None)
            assert (r[f"x_MEAN_VALID_{n}D"], r[f"x_MEAN_SHIFT_VALID_{n}D"]) == (int(bool(now)), int(bool(now and before)))


def test_future_never_changes_features(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([("a", d, rng.random()) for d in range(80)], "e string, day int, x double")
    full = {r["day"]: r for r in rows(windows.rolling(df, "e", "day", ["x"]))}
    for r in rows(windows.rolling(df.where("day <= 40"), "e", "day", ["x"])):
        assert r == full[r["day"]]


def test_filter_stays_above_window(spark):
    df = spark.createDataFrame([("a", day(k)) for k in range(5)], "e string, d date")
    aged = windows.days_since_first_seen(df, "e", "d").where(F.col("d") >= F.lit(day(3)))
    assert [r["DAYS_SINCE_FIRST_SEEN"] for r in rows(aged.orderBy("d"))] == [3, 4]


def test_imputation_levels_and_ties(spark):
    data = [("m", "v", 1, x) for x in [1] * 10 + [2] * 9] + [("m", "v", 1, None)]  # 19 donors in the fine group
    data += [("m", "v", 2, 3)] + [("m", "w", 1, x) for x in [2] * 10 + [5] * 10] + [("m", "w", 1, None)]  # 20 donors, a tie
    data += [("n", "v", 1, None)]
    df = spark.createDataFrame(data, "month string, v string, z int, p int")
    got = {(r["month"], r["v"]): (r["p_imputed"], r["p_method"]) for r in rows(impute.impute_hierarchical(df, "p", impute.fine_coarse_month(["month", "v", "z"], ["month", "v"], "month"))) if r["p_was_missing"]}
    assert got == {("m", "v"): (1, "coarse_mode"), ("m", "w"): (2, "fine_mode"), ("n", "v"): (None, "unresolved")}


@pytest.mark.parametrize("null_safe", [True, False])
def test_merge(spark, null_safe):
    t = spark.createDataFrame([(1, "a", "h1", 1), (2, "b", None, 1), (3, "c", "h3", 1)], "k int, x string, h string, at int")
    s = spark.createDataFrame([(1, "A", "h1", 2), (2, "B", "h2", 2), (4, "D", "h4", 2)], "k int, x string, h string, at int")
    got = {r["k"]: (r["x"], r["at"]) for r in rows(merge.merge_by_hash(t, s, ["k"], "h", "at", F.lit(9), null_safe))}
    assert got == {1: ("a", 1), 2: ("B", 9) if null_safe else ("b", 1), 3: ("c", 1), 4: ("D", 9)}


def test_dedup_latest_nulls_last(spark):
    df = spark.createDataFrame([(1, 5, None), (1, 5, "a"), (1, 4, "z"), (2, 1, None)], "k int, at int, c string")
    got = rows(merge.dedup_latest(df, ["k"], [F.desc("at"), F.col("c").desc_nulls_last()]))
    assert {(r["k"], r["c"]) for r in got} == {(1, "a"), (2, None)}


def test_schema_drift(spark):
    with pytest.raises(merge.SchemaDrift):
        merge.reconcile_columns(spark.range(1), ["id", "x"])


def test_reconciliation_sees_multiplicity(spark):
    make = lambda x: spark.createDataFrame([(v,) for v in x], "v int")
    a, b = make([1, 1, None]), make([1, None])
    assert sets.reconcile(a, b, multiset=False).count() == 0 and [r["error"] for r in rows(sets.reconcile(a, b))] == ["missing"]
    assert sets.same_rows(a, make([None, 1, 1])) and not sets.same_rows(a, b)
    assert rows(sets.reconcile(make([]), b)) and sets.lossless_partition(a, a.where("v = 1"), a.where("v IS NULL")).count() == 0


def test_keys(spark):
    df = spark.createDataFrame([("a", 1), (None, 2)], "x string, y int").select(keys.surrogate_key(F.col("x"), F.col("y")).alias("k"), keys.content_hash("x", "y").alias("h"))
    got = rows(df)
    assert got[1]["k"] is None and len(got[0]["k"]) == 64 and got[0]["h"] != got[1]["h"]


def test_join_guards(spark):
    f, one = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "a")], "k int, x string")
    with pytest.raises(joins.JoinChangedRows):
        joins.count_preserving_join(f, one, ["k"])
    with pytest.raises(joins.JoinChangedRows):
        joins.count_preserving_join(f, one.union(one), ["k"], "left")
    assert joins.count_preserving_join(f, one, ["k"], "left").count() == 2


def test_exists_within_on_a_hot_key(spark):
    rng = random.Random(2)
    obs = [(rng.choice(["hot", "hot", "x"]), rng.randint(0, 100)) for _ in range(200)]
    ev = [(rng.choice(["hot", "y", None]), rng.choice([None, rng.randint(0, 130)])) for _ in range(40)]
    a, e = spark.createDataFrame(obs, "k string, d int"), spark.createDataFrame(ev, "k string, f int")
    got = sorted((r["k"], r["d"], r["near"]) for r in rows(joins.exists_within(a, e, ["k"], "d", "f", 1, 10, "near")))
    assert got == sorted((k, d, any(k == q and f is not None and d < f <= d + 10 for q, f in ev)) for k, d in obs)


def test_null_patterns_and_empty_input(spark):
    df = spark.createDataFrame([(None, None), (1, None), (1, 2), (1, None)], "a int, b int")
    got = [(r["pattern_json"], r["row_count"], r["pattern_rank"], r["observed_patterns"]) for r in rows(profile.null_patterns(df, ["a", "b"]).orderBy("pattern_rank"))]
    assert got == [('["b"]', 2, 1, 3), ('["a","b"]', 1, 2, 3), ("[]", 1, 3, 3)]
    none = df.limit(0)
    assert profile.histogram(none, "a").count() == 0 and profile.duplicate_summary(none, ["a"]).first().excess_rows == 0
    assert profile.histogram(spark.createDataFrame([(3.0,)] * 4, "a double"), "a").collect()[0][0] == 1


def test_histogram_top_value_in_last_bin(spark):
    got = {r["bin"]: r["row_count"] for r in rows(profile.histogram(spark.range(0, 101).withColumnRenamed("id", "x"), "x", 10))}
    assert max(got) == 10 and got[10] == 11


def test_quality_report(spark):
    df = spark.createDataFrame([(1, None), (1, "x"), (2, "y")], "k int, v string")
    got = {r["test_name"]: (r["failing_rows"], r["passed"]) for r in rows(quality.report([quality.Check("nn", quality.not_null(df, "v")), quality.Check("u", quality.unique(df, ["k"]), "warn"), quality.Check("av", quality.accepted_values(df, "v", ["x", "y"]))]))}
    assert got == {"nn": (1, False), "u": (1, False), "av": (0, True)}
    for bad in ({"x": None}, {"x": 1}):
        with pytest.raises(ValueError):
            quality.zero_gate(bad)
    quality.zero_gate({"x": 0})


def test_date_dimension_has_no_gap(spark):
    d = star.date_dimension(spark.createDataFrame([(day(0),), (day(400),)], "d date"), spark.createDataFrame([(day(-3),)], "d date"))
    assert d.count() == 404 and quality.continuous_spine(d, "full_date").count() == 0


def test_code_labels(spark):
    got = [r["l"] for r in rows(spark.createDataFrame([(1,), (None,), (-1,), (7,)], "c int").select(scalar.code_label(F.col("c"), {1: "one"}).alias("l")))]
    assert got == ["one", "NOT_REPORTED", "NOT_REPORTED", "UNRECOGNIZED"]


def test_context_scope(spark):
    df = spark.createDataFrame([(day(k),) for k in range(-100, 100)], "d date")
    b = clean.context_scope(df, "d", str(day(0)), str(day(1))).agg(F.min("d"), F.max("d")).first()
    assert tuple(b) == (day(-59), day(31))


# ---- folds and samples


def test_folds():
    f = splits.folds_between(dt.date(2018, 1, 5), dt.date(2019, 9, 30))
    assert [(x.start, x.end) for x in f] == [(dt.date(2019, m, 1), dt.date(2019, m + 2, 1)) for m in (2, 4, 6, 8)]
    assert all((x.start - x.train_end).days == 30 for x in f)
    with pytest.raises(ValueError):
        splits.folds_between(dt.date(2019, 3, 1), dt.date(2019, 9, 30))


def test_holdout_embargo(spark):
    df = spark.createDataFrame([(day(k),) for k in range(120)], "d date")
    with pytest.raises(ValueError):
        splits.holdout(df, "d", "2024-01-31", "2024-02-15", "2024-03-01")
    train, test = splits.holdout(df, "d", "2024-01-31", "2024-03-05", "2024-03-10")
    assert (train.count(), test.count()) == (31, 6)


def test_entity_sample(spark):
    df = spark.createDataFrame([(f"e{k % 200}", k, int(k % 200 == 3 and k > 700)) for k in range(1000)], "e string, d int, y int")
    a = sampling.entity_sample(df, "e", F.col("y") == 1, 0.3, "s")
    n = {r["e"]: r["count"] for r in a.groupBy("e").count().collect()}
    assert set(n.values()) == {5} and "e3" in n and 35 < len(n) < 90
    assert {r["w"] for r in rows(a.groupBy("e").agg(F.max("weight").alias("w")))} == {1.0, 1 / 0.3}
    assert sets.same_rows(a, sampling.entity_sample(df.repartition(7), "e", F.col("y") == 1, 0.3, "s"))


# ---- preprocessing


def test_preprocessor(spark):
    rng = np.random.default_rng(0)
    x = rng.lognormal(size=(800, 4)) * rng.choice([-1, 1], (800, 4))
    x[rng.random((800, 4)) < 0.2] = np.nan
    x[:, 2], x[:, 3] = np.nan, 5.0
    df = spark.createDataFrame([(i, *(None if np.isnan(v) else float(v) for v in r)) for i, r in enumerate(x)], "i int, a double, b double, c double, d double")
    out = preprocess.Preprocessor().fit(df, ["a", "b", "c", "d"]).transform(df, ["i"]).orderBy("i")
    assert out.columns == ["i", "a", "a_missing", "b", "b_missing", "d"]
    got = np.array([list(r)[1:] for r in out.collect()])
    for k, at in ((0, 0), (1, 2)):
        z = np.sign(x[:, k]) * np.log1p(np.abs(x[:, k]))
        m = np.isnan(z).astype(float)
        z = np.where(np.isnan(z), np.nanmedian(z), z)
        assert np.allclose(got[:, at], (z - z.mean()) / z.std(), atol=1e-6) and np.allclose(got[:, at + 1], (m - m.mean()) / m.std(), atol=1e-6)
    assert np.allclose(got[:, 4], 0)


def test_ecdf(spark):
    t = spark.createDataFrame([(v,) for v in (1.0, 2.0, 2.0, 5.0, None, math.nan)], "x double")
    df = spark.createDataFrame([(v,) for v in (0.0, 1.0, 2.0, 3.0, 9.0, None, math.nan, 2.0)], "x double")
    got = sorted(((r["x"] is None or math.isnan(r["x"]), r["x"] or 0.0) if r["x"] is None or not math.isnan(r["x"]) else (True, 1.0), r["score"]) for r in rows(preprocess.ecdf_score(t, df, "x")))
    assert [s for _, s in got] == [0, 0.25, 0.75, 0.75, 0.75, 1, 0, 0]


# ---- events


def fleet(seed=0, entities=40, days=80):
    rng = np.random.default_rng(seed)
    out = []
    for e in range(entities):
        fail = int(rng.integers(20, days)) if rng.random() < 0.4 else None
        for d in range(fail if fail is not None else days):
            if rng.random() < 0.8:
                out.append((f"d{e}", d, None if rng.random() < 0.05 else round(float(rng.random()), 2), None if fail is None else fail - d))
    return out


def plain_counts(data, tau, span, weight=None):
    """Alerts, hits and late ones by a loop over each entity."""
    a = h = l = 0.0
    by = {}
    for e, d, s, lead in data:
        by.setdefault(e, []).append((d, s, lead))
    for e, r in by.items():
        free, w = -math.inf, 1.0 if weight is None else weight[e]
        for d, s, lead in sorted(r, key=lambda x: x[0]):
            if s is not None and s >= tau and d >= free:
                a += w
                if lead is not None and 7 <= lead <= 30:
                    h += w
                elif lead is not None and 1 <= lead < 7:
                    l += w
                free = math.inf if span is None else d + span
    return a, h, l


SCHEMA = "e string, d int, s double, days_to_failure int"


@pytest.mark.parametrize("span", [30, 5, None])
def test_episodes_and_curve(spark, span):
    data = fleet()
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    taus = [0.95, 0.7, 0.4, 0.1, 2.0]
    got = {r["tau"]: (r["alerts"], r["hits"], r["late"]) for r in rows(events.curve(df, "e", "d", "s", taus, span))}
    for t in taus:
        want = plain_counts(data, t, span)
        assert got[t] == want
        p = events.point(df, "e", "d", "s", t, 0.5, span).first()
        assert (p.alerts, p.hits, p.late) == want


def test_weight_is_repetition(spark):
    data = fleet(3, 12)
    w = {e: float(1 + int(e[1:]) % 3) for e, *_ in data}
    df = spark.createDataFrame([(*r, w[r[0]]) for r in data], SCHEMA + ", w double")
    assert [(r["alerts"], r["hits"], r["late"]) for r in rows(events.curve(df, "e", "d", "s", [0.6], 30, "w"))] == [plain_counts(data, 0.6, 30, w)]


def test_episode_definitions(spark):
    a = [("A", d, s, 12 - d) for d, s in zip(range(4), (0.9, 0.1, 0.1, 0.1))] + [("B", d, 0.9, 5 - d) for d in range(4)] + [("C", d, s, None) for d, s in zip(range(4), (0.95, 0.1, 0.1, 0.1))]
    p = events.point(spark.createDataFrame(a, SCHEMA), "e", "d", "s", 0.5).first()
    assert (p.alerts, p.hits, p.late, p.events, p.precision, p.recall) == (3, 1, 1, 1, round(1 / 3, 6), 1.0)
    long = [("A", k, 0.9 if lead in (45, 10) else 0.0, lead) for k, lead in enumerate(range(45, 9, -1))]
    df = spark.createDataFrame(long, SCHEMA)
    assert [(q.alerts, q.hits) for q in (events.point(df, "e", "d", "s", 0.5).first(), events.point(df, "e", "d", "s", 0.5, duration=None).first())] == [(2, 1), (1, 0)]
    calm = events.point(spark.createDataFrame([("A", d, 1.0, None) for d in range(90)], SCHEMA), "e", "d", "s", 0.5).first()
    assert (calm.alerts, calm.hits, calm.events, calm.precision) == (3, 0, 0, 0.0)


def test_thresholds(spark):
    data = fleet(5)
    s = np.array([r[2] for r in data if r[2] is not None])
    ranks = np.unique(np.round(np.logspace(0, np.log10(len(s)), 40)).astype(int) - 1)
    df = spark.createDataFrame(data, SCHEMA)
    assert events.thresholds(df, "s", 40) == sorted({float(x) for x in np.sort(s)[::-1][ranks]}, reverse=True)
    assert events.thresholds(df.limit(0), "s") == []


def test_pr_auc(spark):
    data = fleet(7)
    df = spark.createDataFrame(data, SCHEMA)
    good = df.withColumn("s", F.when(F.col("days_to_failure").between(7, 30), 1.0).otherwise(0.0))
    n = events.anticipable(df, "e").first()["events"]
    area = lambda d: events.pr_auc(events.curve(d, "e", "d", "s", events.thresholds(d, "s", 60)), n).first()["pr_auc"]
    assert area(good) == 1.0
    base = area(df)
    assert 0 < base < 0.6 and area(df.withColumn("s", F.exp("s") * 3)) == base
    c = [(r["alerts"], r["hits"]) for r in rows(events.curve(df, "e", "d", "s", events.thresholds(df, "s", 60)))]
    r, p = np.array([h / n for _, h in c]), np.array([h / a for a, h in c])
    order = np.lexsort((-p, r))
    want, last = 0.0, 0.0
    for k, i in enumerate(order):
        want += (r[i] - last) * max(p[j] for j in order[k:])
        last = r[i]
    assert base == pytest.approx(want, abs=1e-6)
    assert events.pr_auc(events.curve(df, "e", "d", "s", [0.5]), 0).first()["pr_auc"] is None


def test_costs(spark):
    df = spark.createDataFrame(fleet(9), SCHEMA)
    n, months = events.anticipable(df, "e").first()["events"], events.exposure(df, "e", "d").first()["entity_months"]
    c = events.curve(df, "e", "d", "s", events.thresholds(df, "s", 50))
    got = sorted(rows(cost.sweep(c, n, months)), key=lambda r: r["k"])
    assert all(r["cost"] <= r["cost_without_model"] for r in got) and [r["alerts"] for r in got] == sorted(r["alerts"] for r in got)
    again = cost.apply_thresholds(df, "e", "d", "s", [(r["k"], r["tau"]) for r in got])
    assert all(round(a["cost"], 4) == r["cost"] for a, r in zip(again, got))
    b = cost.threshold_for_budget(c, months, 200.0).first()
    assert b.rate <= 200 and all(1000 * r["alerts"] / months > 200 or r["alerts"] <= b.alerts for r in rows(c))


def test_ranking_metrics(spark):
    rng = np.random.default_rng(4)
    s, y = np.round(rng.random(500), 1), (rng.random(500) < 0.3).astype(int)
    df = spark.createDataFrame(list(zip(s.tolist(), y.tolist())), "s double, y int")
    pairs = [(a > b) + 0.5 * (a == b) for a in s[y == 1] for b in s[y == 0]]
    assert metrics.roc_auc(df, "s", "y").first()[0] == pytest.approx(np.mean(pairs), abs=1e-6)
    ap = sum(((s == t) & (y == 1)).sum() / y.sum() * y[s >= t].mean() for t in np.unique(s))
    assert metrics.average_precision(df, "s", "y").first()[0] == pytest.approx(ap, abs=1e-6)


def test_bernoulli_and_caps(spark):
    df = spark.range(20_000).select("id", (F.col("id") % 100).alias("e"))
    assert abs(sampling.bernoulli(df, 10, 3).count() - 2000) < 250 and sampling.bernoulli(df, 10, 3).count() == sampling.bernoulli(df, 10, 3).count()
    assert sampling.cap_rows(df, "e", F.lit(False), None).count() == sampling.cap_rows(df, "e", F.lit(False), 20_000).count() == 20_000
    some = sampling.cap_rows(df, "e", F.col("e") == 1, 5000)
    assert 2000 < some.count() < 8000 and {r.weight for r in some.select("weight").distinct().collect()} == {1.0, 4.0}


def test_modes_are_broadcast_or_joined(spark, monkeypatch):
    from tarnforge.operators import impute

    rng = random.Random(3)
    df = spark.createDataFrame([(rng.choice("ab"), rng.choice("xyz"), rng.choice([None, 1, 2, 3])) for _ in range(300)], "f string, c string, v int")
    levels = [("fine", ["f", "c"], 40), ("coarse", ["f"], 30), ("all", [], None)]
    one = sorted(map(str, impute.impute_hierarchical(df, "v", levels).collect()))
    monkeypatch.setattr(impute, "FEW", 0)
    assert sorted(map(str, impute.impute_hierarchical(df, "v", levels).collect())) == one


def test_curves_of_groups_are_curves_of_each(spark):
    from tarnforge.operators import events

    rng = random.Random(5)
    rows = [(g, e, day, rng.choice([None, float("nan"), 1.0, 2.0, 3.5, rng.random() * 4]), rng.choice([None, 3, 9, 20])) for g in "pq" for e in range(12) for day in range(30)]
    df = spark.createDataFrame(rows, "g string, e int, day int, s double, days_to_failure int")
    taus = events.thresholds_by(df, "g", "s", 9)
    both = events.curve_by(df, "g", "e", "day", "s", taus, 5)
    areas = {r.g: r.pr_auc for r in events.pr_auc_by(both, ["g"], 12).collect()}
    for g in "pq":
        own = df.where(F.col("g") == g)
        assert taus[g] == events.thresholds(own, "s", 9)
        one = events.curve(own, "e", "day", "s", taus[g], 5)
        assert sorted(map(tuple, one.collect())) == sorted(map(tuple, both.where(F.col("g") == g).drop("g").collect()))
        assert areas[g] == events.pr_auc(one, 12).first().pr_auc
    assert events.thresholds(df.where("false"), "s", 9) == [] and events.curve(df, "e", "day", "s", [], 5).count() == 0
