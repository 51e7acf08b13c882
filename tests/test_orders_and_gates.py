"""Global orders by ranges, tests inside a write, caches in buckets."""

import random

import pytest
from pyspark.sql import functions as F

from tarnforge.operators import quality, ranks, windows
from tarnforge.sources import publish, snapshot


@pytest.mark.parametrize("n", [0, 1, 5, 300])
def test_places_and_neighbours(spark, n):
    rng = random.Random(n)
    rows = sorted(((rng.randrange(20), k) for k in range(n)), key=lambda r: (-r[0], r[1]))
    df = spark.createDataFrame(rng.sample(rows, n), "a int, k int").repartition(3)
    got = {r.k: r for r in ranks.ordered(df, [F.desc("a"), F.asc("k")], "p", {"one": ("k", 1), "seven": ("a", 7)}, {"two": ("k", 2)}).collect()}
    assert len(got) == n
    for i, (a, k) in enumerate(rows):
        want = (i + 1, rows[i - 1][1] if i else None, rows[i - 7][0] if i >= 7 else None, rows[i + 2][1] if i + 2 < n else None)
        assert (got[k].p, got[k].one, got[k].seven, got[k].two) == want


def test_no_task_sees_all_rows(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 7).alias("v"))
    plan = ranks.ordered(df, [F.asc("id")], "p", {"b": ("v", 1)})._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "rangepartitioning" not in plan  # the range exchange lies before the checkpoint
    days = spark.sql("SELECT explode(sequence(DATE '2024-01-01', DATE '2024-03-01')) AS d").where("d NOT IN (DATE '2024-02-02', DATE '2024-02-03')")
    assert [(str(r.d), str(r.previous)) for r in windows.gaps(days.repartition(5), "d").collect()] == [("2024-02-04", "2024-02-01")]


def test_gate_counts_in_the_pass_of_the_write(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.0), (None, -1.0), (3, None)], "k int, v double")
    tests = {"null_key": F.col("k").isNull(), "negative": F.col("v") < 0}
    with pytest.raises(ValueError, match="negative"):
        publish.write_tested(df, str(tmp_path / "bad"), tests)
    assert spark.read.parquet(str(tmp_path / "bad")).count() == 3  # it stays for inspection
    rows, counts = publish.write_tested(df.where("k = 1"), str(tmp_path / "good"), tests)
    assert counts == {"row_count": 1, "null_key": 0, "negative": 0} and rows.count() == 1
    stored = spark.read.parquet(str(tmp_path / "bad"))
    assert quality.flag_counts(stored, list(tests)) == {"row_count": 3, "null_key": 1, "negative": 1}
    plan = stored.agg(F.count_if(F.col(quality.FLAGS) > 0))._jdf.queryExecution().executedPlan().toString()
    assert f"ReadSchema: struct<{quality.FLAGS}:bigint>" in plan  # the rows are not read again


def test_windows_over_an_entity_cache_need_no_exchange(spark):
    df = spark.range(400).select((F.col("id") % 9).alias("e"), F.col("id").cast("int").alias("day"), F.rand(1).alias("v"))
    try:
        c = snapshot.entity_cache(df, "_entities", "e", "day", 4)
        r = windows.rolling(c, "e", "day", ["v"], (7,))
        assert "Exchange" not in r._jdf.queryExecution().executedPlan().toString()
        j = c.join(c.groupBy("e").agg(F.max("day").alias("last")).hint("merge"), "e")
        assert "Exchange hash" not in j._jdf.queryExecution().executedPlan().toString()
        assert r.count() == 400
    finally:
        spark.sql("DROP TABLE IF EXISTS _entities")
