"""Plans that must hold at scale: exchanges, sorts, pushed filters, no nested loops over growing sides."""

import contextlib
import io

import pytest
from pyspark.sql import functions as F

from tarnforge.operators import events, impute, joins, merge, preprocess, profile, windows


@pytest.fixture(scope="module")
def series(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("series") / "t")
    df = spark.range(4000).select((F.col("id") % 50).cast("string").alias("e"), (F.col("id") / 50).cast("int").alias("day"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") / 50).cast("int")).alias("d"), *[F.rand(k).alias(f"x{k}") for k in range(20)])
    df.write.parquet(path)
    return spark.read.parquet(path)


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_windows_share_one_exchange_and_sort(series):
    p = plan(windows.with_shifts(windows.rolling(series, "e", "day", [f"x{k}" for k in range(20)]), [f"x{k}" for k in range(20)]))
    assert p.count("Exchange hashpartitioning") == 1 and p.count("Sort [") == 1


def test_top_k_has_a_group_limit(series):
    assert "WindowGroupLimit" in plan(windows.top_k(series, ["e"], [F.desc("x0"), F.col("day")], 3))
    assert "WindowGroupLimit" in plan(merge.dedup_latest(series, ["e"], [F.desc("day")]))


def test_filters_and_columns_reach_the_scan(series):
    p = plan(series.where(F.col("d") >= F.lit("2024-02-01").cast("date")).groupBy("e").agg(F.sum("x3")))
    assert "PushedFilters: [IsNotNull(d), GreaterThanOrEqual(d,2024-02-01)]" in p and "ReadSchema: struct<e:string,d:date,x3:double>" in p


def test_profiles_scan_once(series):
    for df in (profile.null_profile(series, ["e"], ["x0", "x1", "x2"]), profile.null_correlations(series, ["e"], ["x0", "x1", "x2"]), profile.missingness_risk(series, ["x0", "x1"], F.col("x2") > 0.5)):
        assert plan(df).count("FileScan") == 1


def test_band_existence_is_an_equi_join(series):
    p = plan(joins.exists_within(series.select("e", "day"), series.select("e", F.col("day").alias("f")), ["e"], "day", "f", 1, 30, "near"))
    assert "NestedLoop" not in p and "Cartesian" not in p


def test_no_window_over_raw_rows(series):
    """Ranks go over counts of distinct values: below the single partition there is an aggregate."""
    p = plan(preprocess.ecdf_score(series, series, "x0"))
    assert "NestedLoop" not in p
    p = plan(impute.mode_by(series.withColumn("k", F.col("day") % 3), ["e"], "k"))
    assert "Window" not in p


def test_episodes_stay_in_the_jvm(series):
    p = plan(events.episodes(series.withColumn("days_to_failure", F.lit(None).cast("int")), "e", "day", "x0", 0.5))
    assert "Python" not in p and "Pandas" not in p and p.count("Exchange hash") == 2


def test_running_sums_of_range_partitions(spark):
    import random

    from tarnforge.operators.ranks import running_sums

    values = random.Random(1).sample(range(10_000), 500)
    df = spark.createDataFrame([(v, v % 7) for v in values], "v long, n long").repartition(5)
    for down in (False, True):
        seen, want = 0, {}
        for v in sorted(values, reverse=down):
            seen += v % 7
            want[v] = seen
        got = {r.v: (r.s, r.s_all) for r in running_sums(df, "v", {"s": "n"}, down).collect()}
        assert got == {v: (s, seen) for v, s in want.items()}
