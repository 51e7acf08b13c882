"""Raw files, snapshots, publication helpers, models and the run log."""

import datetime as dt
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from tarnforge.operators import metrics, models, splits
from tarnforge.sources import bronze, publish, snapshot, tables


def test_zip_members(tmp_path):
    path = str(tmp_path / "a.zip")
    with zipfile.ZipFile(path, "w") as z:
        for n in ("x/20180102.csv", "x/20180101.csv", "__MACOSX/20180101.csv", "x/.hidden.csv", "readme.txt"):
            z.writestr(n, 'a,b\n1,"2"\n3,4\n')
    assert bronze.eligible_members(path) == [("2018-01-01", "x/20180101.csv"), ("2018-01-02", "x/20180102.csv")]
    out = str(tmp_path / "o.csv")
    assert bronze.extract_member(path, "x/20180101.csv", ["a", "b"], out) == 2
    assert open(out).read().splitlines()[1] == "a.zip,x/20180101.csv,2,20180101,1,2"
    with pytest.raises(bronze.SourceError):
        bronze.extract_member(path, "x/20180101.csv", ["a", "c"], out)
    with zipfile.ZipFile(path, "a") as z:
        z.writestr("undated.csv", "a,b\n")
    with pytest.raises(bronze.SourceError):
        bronze.eligible_members(path)
    assert len(bronze.eligible_members(path, dated=False)) == 3


def test_plan():
    days = [f"2018-{m:02d}-{d:02d}" for m in range(1, 13) for d in (1, 15)]
    p = bronze.plan_loads(days, "2018-02-10", "2018-12-31")
    assert len(p) <= 6 and sum((x["dates"] for x in p), []) == [d for d in days if d >= "2018-02-10"]
    with pytest.raises(bronze.SourceError):
        bronze.plan_loads(days, "2020-01-01", "2020-02-01")


def test_csv_with_lineage(spark, tmp_path):
    for f, n in (("a.csv", 5000), ("b.csv", 7)):
        (tmp_path / f).write_text("x,y\n" + "".join(f"{k},\n" for k in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")  # several splits a file
    try:
        got = bronze.read_csv(spark, f"{tmp_path}/*.csv", ["x", "y"], "z.zip").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == 5007 and all(r.source_row == int(r.x) + 2 and r.y is None and r.source_archive == "z.zip" for r in got)
    with pytest.raises(bronze.SourceError):
        bronze.read_csv(spark, f"{tmp_path}/a.csv", ["y", "x"])
    (tmp_path / "c.csv").write_text("x,y\n1,2,3\n")
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST"):
        bronze.read_csv(spark, f"{tmp_path}/c.csv", ["x", "y"]).collect()


def test_parquet_records(spark, tmp_path):
    spark.createDataFrame([(1, None), (2, "b")], "a int, b string").coalesce(1).write.parquet(f"{tmp_path}/t")
    got = bronze.read_parquet(spark, f"{tmp_path}/t", "2025-01").select("source_row_number", F.to_json("raw_record").alias("j"), "source_content_key").collect()
    assert sorted((r.source_row_number, r.j) for r in got) == [(1, '{"a":1,"b":null}'), (2, '{"a":2,"b":"b"}')] and len({r.source_content_key for r in got}) == 1
    f = next(f"{tmp_path}/t/{n}" for n in os.listdir(f"{tmp_path}/t") if n.endswith(".parquet"))
    assert len(bronze.parquet_envelope(f)) == 64 and snapshot.footer_nulls(f, ["a", "b"]) == {"a": 0, "b": 1}
    (tmp_path / "bad").write_text("PAR1 no")
    with pytest.raises(bronze.SourceError):
        bronze.parquet_envelope(str(tmp_path / "bad"))


def test_fetch_is_whole_or_not_there(spark, tmp_path):
    import io

    spark.range(3).coalesce(1).write.parquet(f"{tmp_path}/t")
    good = next((tmp_path / "t").glob("*.parquet")).read_bytes()
    answers = [b"PAR1 cut off", OSError("gone"), good]

    def source():
        x = answers.pop(0)
        if isinstance(x, OSError):
            raise x
        return io.BytesIO(x)

    to = str(tmp_path / "copy.parquet")
    assert bronze.fetch(source, to, attempts=3, pause=0) == bronze.parquet_envelope(to) and spark.read.parquet(to).count() == 3
    answers += [b"", b"PAR1"]
    with pytest.raises(bronze.SourceError):
        bronze.fetch(source, str(tmp_path / "other"), attempts=2, pause=0)
    assert not [n for n in os.listdir(tmp_path) if n.startswith("other")]
    answers += [b""] * 5 + [good]
    bronze.fetch(source, str(tmp_path / "other"), attempts=None, pause=0)


def test_seed(spark, tmp_path):
    (tmp_path / "s.csv").write_text('"a","b"\n"1","x, y"\n')
    assert bronze.read_seed(spark, str(tmp_path / "s.csv")).collect() == [("1", "x, y")]


def test_connector(spark, tmp_path):
    spark.range(10).select("id", (F.col("id") * 2).alias("twice")).write.parquet(f"{tmp_path}/t.parquet")
    c = tables.Connector(spark, str(tmp_path), ".parquet")
    q = c.query("SELECT twice FROM {t} WHERE id > 7;", ["t"])
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.twice for r in q.collect()) == [16, 18] and "GreaterThan(id,7)" in plan
    assert c.table("t", ["id"]).columns == ["id"] and not [v for v in spark.catalog.listTables() if v.name.startswith("_t_")]
    for bad in (lambda: c.table("../t"), lambda: c.query("DROP TABLE {t}", ["t"]), lambda: tables.scan(spark, "a; b")):
        with pytest.raises(bronze.GuardError):
            bad()
    one = tables.session(spark).first()
    assert one.catalog == "spark_catalog" and one.user


def test_guarded_query(spark):
    spark.range(5).createOrReplaceTempView("five")
    assert len(bronze.query_small(spark, "select * from five;", 5)) == 5
    for sql in ("select * from five", "drop table five", "select 1; select 2"):
        with pytest.raises(bronze.GuardError):
            bronze.query_small(spark, sql, 4)
    assert bronze.identifier("a.b_1") == "`a`.`b_1`"
    with pytest.raises(bronze.GuardError):
        bronze.identifier("a; drop")


def test_snapshot(spark, tmp_path):
    path = f"{tmp_path}/snap"
    df = spark.createDataFrame([(f"e{k % 3}", dt.date(2024, 1, 1) + dt.timedelta(k), k % 2) for k in range(90)], "e string, d date, y int")
    snapshot.export(df, path, "d")
    snapshot.reconcile_rows(spark, path, 90)
    m = snapshot.manifest(spark, path, "e", "d", "y", "select 1")
    snapshot.write_manifest(spark, path, m)
    assert (m["rows"], m["positives"], m["entities"], m["first"], m["last"]) == (90, 45, 3, "2024-01-01", "2024-03-30")
    assert snapshot.load(spark, path, ["e", "d"], "d", "e", "2024-02-01", "2024-02-29", ordered=True).count() == 29
    with open(f"{path}/mes=2024-01/note.txt", "w") as f:
        f.write("ignored")
    assert snapshot.dataset_hash(spark, path) == m["dataset_sha256"]
    snapshot.export(df.withColumn("y", F.lit(1)), path, "d")
    with pytest.raises(snapshot.SnapshotError):
        snapshot.load(spark, path, ["e"], "d", "e")
    with pytest.raises(snapshot.SnapshotError):
        snapshot.reconcile_rows(spark, path, 91)
    scan = snapshot.load(spark, path, ["e"], "d", "e", "2024-02-01", verify=False)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(d), GreaterThanOrEqual(d" in scan and "ReadSchema: struct<e:string,d:date>" in scan


def test_frozen_sample_and_cache(spark, tmp_path):
    a = snapshot.freeze(spark.range(3).toDF("x"), f"{tmp_path}/s")
    assert snapshot.freeze(spark.range(9).toDF("x"), f"{tmp_path}/s").count() == a.count() == 3
    snapshot.model_cache(spark.range(4).select(F.col("id").alias("k"), F.date_add(F.lit(dt.date(2024, 1, 1)), F.col("id").cast("int")).alias("d"), F.lit(1.5).alias("x")), f"{tmp_path}/c", ["x"], ["k", "d"], "d")
    assert dict(spark.read.parquet(f"{tmp_path}/c").dtypes)["x"] == "float"


def test_publish(spark, tmp_path):
    root = str(tmp_path)
    for n in (1, 2):
        stage = publish.write_stage(spark.range(n), publish.stage_path(root, "t", publish.run_id(str(n))))
        assert stage.count() == n
        publish.promote(spark, publish.stage_path(root, "t", f"{n}" * 12) if False else stage.inputFiles()[0].rsplit("/", 1)[0], "t_view", root, "t")
        assert spark.table("t_view").count() == n
    assert publish.drop_stages(spark, [f"{root}/_stages"], False) == 0 and publish.drop_stages(spark, [f"{root}/_stages"], True) == 1
    assert publish.redact("Password=abc x") == "Password=*** x"


def test_a_reader_always_finds_a_pointer(spark, tmp_path):
    """Pointers are added under new names; a half-written one is hidden."""
    root = str(tmp_path)
    for n in range(3):
        path = publish.stage_path(root, "t", f"{n}" * 12)
        publish.write_stage(spark.range(n + 1), path)
        publish.promote(spark, path, "t_view", root, "t")
        assert publish.open_published(spark, root, "t").count() == n + 1
    names = sorted(os.listdir(f"{root}/_pointers/t"))
    assert len([x for x in names if x.startswith("p-")]) == 3 and not [x for x in names if x.startswith(".p-") and not x.endswith(".crc")]
    with open(f"{root}/_pointers/t/.p-00000009-x", "w") as f:
        f.write("half")
    assert publish.open_published(spark, root, "t").count() == 3


def test_prompt_cases_and_answers(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.00049, None), (2, float("nan"), 7.0)], "age int, a double, a_mean double")
    got = [r.prompt_case for r in models.prompt_cases(df, "age", ["a"], {"now": "", "mean": "_mean"}).orderBy("age").collect()]
    assert got == ['{"age_days":1.0,"a":{"now":2.0,"mean":null}}', '{"age_days":2.0,"a":{"now":null,"mean":7.0}}']
    with pytest.raises(ValueError):
        models.prompt_cases(df.withColumn("target", F.lit(1)), "target", ["a"], {"now": ""})
    cache, asked = models.KeyedCache(str(tmp_path / "c")), []
    ask = lambda batch: asked.append(batch) or [0.5]
    for batch in ([{"id": 1}], [{"id": 1}], [{"id": 2}]):
        assert cache.answer("m", "say", batch, ask) == [0.5]
    assert len(asked) == 2 and len(os.listdir(tmp_path / "c")) == 2


def test_models(spark):
    rows = [(dt.date(2024, 1, 1) + dt.timedelta(k % 300), float(k % 10), float((k * 7) % 5) if k % 4 else None, int(k % 10 >= 6)) for k in range(1200)]
    df = spark.createDataFrame(rows, "day date, a double, b double, y int").cache()
    folds = splits.embargo_folds(df, "day", n=2, months=1)
    auc = lambda d: metrics.roc_auc(d, "score", "y").first()[0] or 0.0
    best = models.evaluate_folds(df, "day", folds, lambda: models.FAMILIES["logistic"](), ["a", "b"], "y", auc)
    dummy = models.evaluate_folds(df, "day", folds, lambda: models.FAMILIES["prior"](), ["a", "b"], "y", auc)
    assert len(best["values"]) == 2 and best["mean"] > 0.95 > dummy["mean"] == 0.5 and best["oof"].count() == sum(f.validation(df, "day").count() for f in folds)
    with pytest.raises(ValueError):
        models.guard_features(["a", "Days_To_Failure"])


def test_run_log(tmp_path):
    log, calls = models.RunLog(str(tmp_path)), []
    compute = lambda: calls.append(1) or {"mean": 1.0}
    assert log.cached("a", compute) == log.cached("a", compute) == {"mean": 1.0} and len(calls) == 1
    log.alias("champion", log.log({"p": 1}, {"m": 0.5}))
    assert log.reproduces("champion", "m", 0.5 + 1e-8) and not log.reproduces("champion", "m", 0.51)
    seen = []
    best = models.search([{"x": k} for k in (1, 3, 2)], lambda p, prune: seen.append(p["x"]) or {"mean": float(p["x"]), "pruned": prune(0, p["x"])}, log, "s")
    assert best["point"] == {"x": 3} and seen == [1, 3, 2]
    models.search([{"x": 3}], lambda p, prune: seen.append("again") or {}, log, "s")
    assert "again" not in seen


def test_without_training_data_operators():
    """The core never imports the optional subpackage."""
    import pathlib

    root = pathlib.Path(__file__).parent.parent / "tarnforge"
    assert not [p for p in root.rglob("*.py") if "llm" not in p.parts and "tarnforge.llm" in p.read_text()]


def test_archive_is_importable(tmp_path):
    import subprocess
    import sys

    from tarnforge.functions import package

    path = package.archive(str(tmp_path))
    said = subprocess.run([sys.executable, "-c", f"import sys; sys.path.insert(0, {path!r}); import tarnforge.operators.events as e; print(e.__file__)"], cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, capture_output=True, text=True)
    assert path in said.stdout, said.stderr
