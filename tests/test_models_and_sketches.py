"""Newton's regression, tree contributions, sketches, ranks of all columns and episodes by pointers."""

import math
import random
from itertools import chain, combinations

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tarnforge.operators import contributions, events, gram, models, newton, profile, sketches


# ---- regression


def labelled(spark, n=400):
    rng = random.Random(1)
    rows = []
    for _ in range(n):
        a, b = rng.gauss(0, 1), rng.gauss(1, 2)
        rows.append((a, b, int(rng.random() < 1 / (1 + math.exp(-(0.5 + 1.5 * a - 0.7 * b))))))
    return rows, spark.createDataFrame(rows, "a double, b double, y int")


@pytest.mark.parametrize("weighted", [False, True])
def test_newton_reaches_the_least_loss(spark, weighted):
    rows, df = labelled(spark)
    m = newton.Logistic(l2=0.5, weighted=weighted).fit(df.repartition(3), ["a", "b"], "y")
    x, y = np.array([[1, a, b] for a, b, _ in rows]), np.array([r[2] for r in rows])
    w = np.where(y == 1, len(y) / 2 / y.sum(), len(y) / 2 / (1 - y).sum()) if weighted else np.ones(len(y))
    p = 1 / (1 + np.exp(-x @ m.beta))
    slope = x.T @ (w * (y - p)) - 0.5 * np.array([0, *m.beta[1:]])
    assert np.abs(slope).max() < 1e-7 and m.taken < 12
    got = [r.score for r in m.score(df).collect()]
    assert np.allclose(got, p)


def test_newton_on_hard_data(spark):
    split = spark.createDataFrame([(float(k), int(k > 5)) for k in range(12)] + [(None, 1), (3.0, None)], "a double, y int")
    m = newton.Logistic(l2=1e-3, weighted=False).fit(split, ["a"], "y")  # classes that a threshold parts
    s = [r.score for r in m.score(split.dropna()).orderBy("a").collect()]
    assert s == sorted(s) and s[5] < 0.5 < s[6] and m.score(split).where("a IS NULL").first().score is None
    same = spark.createDataFrame([(1.0, 2.0, k % 2) for k in range(10)], "a double, b double, y int")  # columns that depend on each other
    assert abs(newton.Logistic(l2=0.0).fit(same, ["a", "b"], "y").score(same).first().score - 0.5) < 1e-9
    with pytest.raises(ValueError):
        newton.Logistic().fit(same.withColumnRenamed("a", "days_to_failure"), ["days_to_failure"], "y")


def test_gram(spark):
    x = np.random.default_rng(0).normal(size=(50, 4))
    df = spark.createDataFrame([(r.tolist(), float(k)) for k, r in enumerate(x)], "v array<double>, w double").repartition(3)
    for weight in (None, "w"):
        want = x.T @ (x * (np.arange(50.0)[:, None] if weight else 1))
        assert all(abs(r.s - want[r.i, r.j]) < 1e-9 for r in gram.gram(df, "v", weight).collect())
    assert gram.gram(df.limit(0), "v").count() == 0


# ---- contributions


def nodes(at):
    """A Spark tree as nested tuples."""
    if at.subtreeDepth() == 0:
        return at
    return at.split().featureIndex(), at.split().threshold(), at.leftChild().impurityStats().count(), at.rightChild().impurityStats().count(), nodes(at.leftChild()), nodes(at.rightChild())


def expected(node, x, known, value):
    if not isinstance(node, tuple):
        return value(node)
    f, t, a, b, left, right = node
    if f in known:
        return expected(left if x[f] <= t else right, x, known, value)
    return (a * expected(left, x, known, value) + b * expected(right, x, known, value)) / (a + b)


def brute(trees, x, n, value):
    """The Shapley sum over all subsets of all features."""
    f = lambda s: sum(expected(t, x, s, v) for t, v in zip(trees, value))
    out = []
    for j in range(n):
        rest = [k for k in range(n) if k != j]
        total = 0.0
        for s in chain.from_iterable(combinations(rest, k) for k in range(n)):
            total += math.factorial(len(s)) * math.factorial(n - len(s) - 1) / math.factorial(n) * (f({*s, j}) - f(set(s)))
        out.append(total)
    return out, f(set())


@pytest.mark.parametrize("family", ["forest", "boosting"])
def test_contributions_equal_all_subsets(spark, family):
    rng = random.Random(3)
    rows = [tuple(rng.choice([0.0, 1.0, rng.gauss(0, 1)]) for _ in range(4)) for _ in range(300)]
    df = spark.createDataFrame([(*r, int(r[0] + r[1] * r[2] + rng.gauss(0, 0.3) > 0.5)) for r in rows], "a double, b double, c double, d double, y int")
    m = models.FAMILIES[family](**({"trees": 5, "depth": 4} if family == "forest" else {"rounds": 3, "depth": 3})).fit(df, ["a", "b", "c", "d"], "y")
    fitted = m.model.stages[-1]
    x = m.model.transform(m.prep.transform(df, []))
    value = F.get(vector_to_array("probability" if family == "forest" else "rawPrediction"), F.lit(1)).alias("value")
    got = contributions.contributions(x.select(vector_to_array("_x").alias("x"), value), "x", contributions.ensemble(fitted), len(m.inputs)).limit(25).collect()
    trees = [nodes(t._java_obj.rootNode()) for t in fitted.trees]
    prob = lambda at: list(at.impurityStats().stats())[1] / sum(at.impurityStats().stats()) / len(trees)
    values = [prob] * len(trees) if family == "forest" else [lambda at, w=w: w * at.prediction() for w in fitted.treeWeights]
    for r in got:
        want, base = brute(trees, r.x, len(m.inputs), values)
        assert np.allclose(r.contributions, want, atol=1e-9) and abs(r.base - base) < 1e-9
        assert abs(r.base + sum(r.contributions) - r.value) < 1e-9 or family == "boosting" and abs(2 * (r.base + sum(r.contributions)) - r.value) < 1e-9
    ranked = contributions.importance(spark.createDataFrame(got), m.inputs).orderBy(F.desc("mean_abs_contribution")).first()
    assert ranked.column_name in m.inputs


def test_a_tree_of_one_leaf_contributes_nothing(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([3.0, 4.0],)], "x array<double>")
    got = contributions.contributions(df, "x", [contributions.Leaf(0.3, {}, {})], 2).collect()
    assert [(list(r.contributions), r.base) for r in got] == [([0.0, 0.0], 0.3)] * 2
    assert contributions.contributions(df.limit(0), "x", [], 2).count() == 0


# ---- sketches


def test_sketches_by_month(spark, tmp_path):
    rows = [(f"2024-0{k % 3 + 1}-15", float(k), None if k % 4 else float(k % 10)) for k in range(9000)]
    df = spark.createDataFrame(rows, "day string, a double, b double").withColumn("day", F.to_date("day"))
    path = str(tmp_path / "s")
    sketches.append(df.where("month(day) < 3"), path, "day", ["a", "b"])
    import os

    old = {f: os.stat(f"{path}/{d}/{f}").st_mtime_ns for d in os.listdir(path) if d.startswith("month") for f in os.listdir(f"{path}/{d}")}
    sketches.append(df.where("month(day) = 3"), path, "day", ["a", "b"])
    now = {f: os.stat(f"{path}/{d}/{f}").st_mtime_ns for d in os.listdir(path) if d.startswith("month") for f in os.listdir(f"{path}/{d}")}
    assert old.items() < now.items()  # old months keep their files
    p = {r.column_name: r for r in sketches.profile(sketches.merged(sketches.stored(spark, path)), {"q10": 0.1, "q90": 0.9}).collect()}
    assert (p["a"].row_count, p["a"].null_count, p["a"].low, p["a"].high, p["a"].mean) == (9000, 0, 0.0, 8999.0, 4499.5)
    assert abs(p["a"].n_unique - 9000) <= sketches.DISTINCT_ERROR * 9000 and abs(p["a"].q10 / 9000 - 0.1) <= sketches.RANK_ERROR and abs(p["a"].q90 / 9000 - 0.9) <= sketches.RANK_ERROR
    assert (p["b"].null_count, p["b"].n_unique) == (6750, 5) and abs(p["a"].deviation - np.std(np.arange(9000), ddof=1)) < 1e-6
    assert sketches.merged(sketches.stored(spark, path, "2024-02-01", "2024-02-29")).where("column_name = 'a'").first().row_count == 3000
    sketches.append(df.where("month(day) = 3 AND a < 100"), path, "day", ["a", "b"])  # a month given again
    assert sketches.merged(sketches.stored(spark, path)).where("column_name = 'a'").first().row_count == 6033


def test_scores_from_a_grid(spark):
    df = spark.range(5000).select(F.to_date(F.lit("2024-01-01")).alias("day"), (F.col("id") % 1000).cast("double").alias("a"))
    g = sketches.grid(sketches.merged(sketches.monthly(df, "day", ["a"])), "a", 200)
    rows = sketches.with_score(spark.createDataFrame([(-1.0,), (0.0,), (499.0,), (999.0,), (None,)], "a double"), "a", g).collect()
    want = [0.0, 0.001, 0.5, 1.0, None]
    assert all(r.score is None if w is None else abs(r.score - w) <= sketches.RANK_ERROR + 1 / 200 for r, w in zip(rows, want))
    assert sketches.with_score(df, "a", []).first().score is None


def test_sketches_of_nulls_alone(spark):
    df = spark.sql("SELECT DATE '2024-01-01' AS day, CAST(NULL AS double) AS a FROM range(5)")
    r = sketches.profile(sketches.merged(sketches.monthly(df, "day", ["a"])), {"q": 0.5}).first()
    assert (r.row_count, r.null_count, r.mean, r.q, r.n_unique) == (5, 5, None, None, 0)


# ---- ranks


def plain_ranks(x):
    order = sorted(x)
    first, count = {}, {}
    for i, v in enumerate(order):
        first.setdefault(v, i)
        count[v] = count.get(v, 0) + 1
    return [first[v] + (count[v] + 1) / 2 for v in x]


def test_one_ranking_of_all_columns(spark):
    rng = random.Random(8)
    cols = [f"c{k}" for k in range(6)]
    rows = [tuple(rng.choice([None] * (rng.random() < 0.02) + [float(rng.randrange(2 + 3 * k))]) for k in range(6)) for _ in range(500)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols)).repartition(3)
    live = [r for r in rows if None not in r]
    ranks = [np.array(plain_ranks([r[k] for r in live])) for k in range(6)]
    got = {r.column_name: r.spearman for r in profile.rank_correlations(df, cols[:5], "c5").collect()}
    assert all(abs(got[cols[k]] - np.corrcoef(ranks[k], ranks[5])[0, 1]) < 1e-6 for k in range(5))
    pairs = {(r.left_column, r.right_column): r.spearman for r in profile.rank_matrix(df, cols).collect()}
    assert set(pairs) == set(combinations(cols, 2)) and all(abs(v - np.corrcoef(ranks[cols.index(a)], ranks[cols.index(b)])[0, 1]) < 1e-6 for (a, b), v in pairs.items())


def test_exchanges_of_ranks_do_not_grow_with_the_columns(spark):
    cols = [f"c{k}" for k in range(12)]
    df = spark.range(50).select(*[((F.col("id") * (k + 3)) % 17).cast("double").alias(c) for k, c in enumerate(cols)])
    text = [profile.rank_correlations(df, cols[:n], "c11")._jdf.queryExecution().executedPlan().toString().count("Exchange") for n in (2, 11)]
    assert text[0] == text[1]


# ---- episodes


@pytest.mark.parametrize("span", [1, 5, 1 << 40])
def test_openers_by_pointers_equal_a_walk(span):
    rng = random.Random(span)
    entity, day = [], []
    for e in range(60):
        own = sorted(rng.sample(range(-50, 300), rng.choice([1, 2, 40, 200])))
        entity += [e * 3] * len(own)
        day += own
    want, free = [], {}
    for e, d in zip(entity, day):
        opens = d >= free.get(e, -(10**9))
        want.append(opens)
        if opens:
            free[e] = d + span
    assert events.episode_openers(np.array(entity), np.array(day), span).tolist() == want
    assert len(events.episode_openers(np.zeros(0, int), np.zeros(0, int), span)) == 0
