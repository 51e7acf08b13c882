"""Results and plans that must hold on tables of many partitions."""

import random

import duckdb
from pyspark.sql import functions as F

from tarnforge.operators import profile
from tarnforge.operators.ranks import quantiles
from tarnforge.sources import snapshot


def test_hashes_do_not_depend_on_the_order_of_rows(spark, tmp_path):
    df = spark.range(3000).select("id", (F.col("id") % 7).alias("v"), F.expr("if(id % 100 = 0, null, date_add(date '2024-01-01', int(id % 60)))").alias("d"))
    got = []
    for k, rows in enumerate((df.coalesce(1), df.repartition(5, "v"), df.orderBy(F.desc("id")))):
        snapshot.export(rows, f"{tmp_path}/{k}", "d")
        got.append({(r.file.rsplit("/", 1)[0], r.content_sha256) for r in snapshot.file_hashes(spark, f"{tmp_path}/{k}").collect()})
    assert got[0] == got[1] == got[2] and {f for f, _ in got[0]} == {"mes=2024-01", "mes=2024-02", "mes=__HIVE_DEFAULT_PARTITION__"}
    back = spark.read.parquet(f"{tmp_path}/1")
    assert back.count() == 3000 and back.where("mes IS NULL").count() == back.where("d IS NULL").count() == 30


def test_hashes_of_content_leave_the_footer_out(spark, tmp_path):
    one = lambda: snapshot.file_hashes(spark, str(tmp_path)).first()
    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "a"))
    before = one()
    (path,) = (tmp_path / "a").glob("*.parquet")
    raw = path.read_bytes()
    changed = {}
    for name, old, new in (("writer", b"parquet-mr version", b"parquet-mr Version"), ("schema", b'"name":"id"', b'"name":"ix"'), ("pages", raw[40:44], b"abcd")):
        assert raw.count(old) >= 1
        for f in (tmp_path / "a").glob(".*.crc"):
            f.unlink()
        path.write_bytes(raw.replace(old, new, 1))
        changed[name] = one()
    assert all(r.sha256 != before.sha256 for r in changed.values())
    assert [n for n, r in changed.items() if r.content_sha256 != before.content_sha256] == ["schema", "pages"]


def test_payload_duplicates_are_one_grouping_and_keep_null_keys(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "a"), (None, "c"), (None, "c"), (None, None), (None, None)], "k int, p string")
    out = profile.payload_duplicates(df, ["k"], ["p"])
    assert sorted(tuple(r) for r in out.fillna(0).groupBy("k", "copies").count().collect()) == [(0, 2, 2), (1, 2, 1)]
    text = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in text and text.count("Exchange") == 1


FRACTIONS = [0.0, 0.25, 0.5, 0.75, 0.999, 1.0]


def test_quantiles_are_exact(spark):
    odd = F.when(F.col("id") % 97 == 0, None).when(F.col("id") % 89 == 0, float("inf")).when(F.col("id") % 83 == 0, -float("inf")).when(F.col("id") % 5 == 0, 7.0).otherwise(F.rand(3) * 1e6 - 5e5)
    df = spark.range(20000).repartition(6).withColumns({"x": odd, "g": F.when(F.col("id") % 4 > 0, F.concat(F.lit("g"), F.col("id") % 4))}).cache()
    df = df.unionByName(spark.createDataFrame([(0, None, "empty"), (1, 2.5, "one")], "id long, x double, g string"))
    want = F.percentile("x", F.array(*map(F.lit, FRACTIONS))).alias("_q")
    flat = lambda rows: {str(r[:-1]): r["_q"] and [float(f"{v:.12g}") for v in r["_q"]] for r in rows.collect()}
    for accuracy in (10_000, 3):  # brackets of few rows, and brackets that may miss
        assert flat(quantiles(df, "x", FRACTIONS, ["g"], accuracy=accuracy)) == flat(df.groupBy("g").agg(want))
        assert flat(quantiles(df, "x", FRACTIONS, accuracy=accuracy)) == flat(df.agg(want))
    assert quantiles(df.where("false"), "x", [0.5]).collect() == [(None,)] and quantiles(df.where("false"), "x", [0.5], ["g"]).collect() == []
    rows = [(i, random.Random(i).uniform(900, 105000)) for i in range(200) for i in (i, i + 1000)]
    two = spark.createDataFrame(rows, "i int, x double").withColumn("g", F.col("i") % 1000)
    with duckdb.connect() as c:
        c.execute("CREATE TABLE t (g int, x double)")
        c.executemany("INSERT INTO t VALUES (?, ?)", [(i % 1000, x) for i, x in rows])
        want = c.execute(f"SELECT g, quantile_cont(x, {FRACTIONS}) FROM t GROUP BY 1").fetchall()
    assert sorted(tuple(r) for r in quantiles(two, "x", FRACTIONS, ["g"]).collect()) == sorted(want)


def without_percentile(df):
    return "percentile(" not in df._jdf.queryExecution().executedPlan().toString()


def test_iqr_outliers_hold_no_map_of_all_values(spark):
    size = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = profile.iqr_outliers(spark.range(10).withColumn("g", F.col("id") % 2), "id", ["g"])
        assert without_percentile(out) and "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", size)


def test_univariate_holds_no_map_of_all_values(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 2.0), ("a", None), ("b", 4.0)], "g string, x double")
    assert without_percentile(profile.univariate(df, "x", ["g"])) and without_percentile(profile.univariate(df, "x"))
    got = {r.g: (r.total_rows, r.q1, r.median, r.q3) for r in profile.univariate(df, "x", ["g"]).collect()}
    assert got == {None: (2, 1.25, 1.5, 1.75), "a": (1, None, None, None), "b": (1, 4.0, 4.0, 4.0)}
    assert profile.univariate(df.where("false"), "x").first().total_rows == 0


def test_outliers_and_lifts_hold_no_map_of_all_values(spark):
    df = spark.range(1000).select((F.col("id") * 1.5).alias("x"), (F.col("id") % 2).alias("y"))
    assert all(map(without_percentile, (profile.outlier_lift(df, "x", "y"), profile.quantile_lift(df, "x", "y"), profile.descriptives(df, "x"))))


def test_rank_correlations_do_not_deal_rows_by_the_target(spark):
    df = spark.range(2000).select((F.col("id") * 7 % 1000).alias("x"), (F.col("id") % 2).alias("y"))
    size = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = profile.rank_correlations(df, ["x"], "y")
        by_target = [line for line in out._jdf.queryExecution().executedPlan().toString().splitlines() if "Join [" in line and "(t#" in line]
        assert by_target and all("BroadcastHashJoin" in line for line in by_target)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", size)
