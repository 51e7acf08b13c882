"""Tables in key ranges and streams with state that ends."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tarnforge.operators import events
from tarnforge.sources.ranges import Conflict, RangeTable, range_sink
from tarnforge.streaming import stateful

COLS = "k int, part string, v string, h string, at int"


def made(spark, rows):
    return spark.createDataFrame(rows, COLS)


def content(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture
def table(spark, tmp_path):
    t = RangeTable(spark, str(tmp_path / "t"), ["k", "part"], range_rows=25)
    t.create(made(spark, [(k, "a", f"v{k}", f"h{k}", 0) for k in range(100)] + [(None, "a", "null", "n", 0)]))
    return t


def test_a_merge_writes_to_touched_ranges_only(spark, table):
    before = table.files()
    assert len(before) >= 4
    batch = [(10, "a", "new", "x", 2), (10, "a", "newest", "y", 3), (11, "a", "v11", "h11", 9), (12, "b", "other", "z", 1), (None, "a", "n2", "m", 1)]
    table.merge(made(spark, batch), [F.desc("at")], "h")
    after = table.files()
    changed = [k for k in before if before[k] != after[k]]
    assert len(changed) == 1 and all(after[k][: len(before[k])] == before[k] for k in before)
    want = {(k, "a"): f"v{k}" for k in range(100)} | {(None, "a"): "n2", (10, "a"): "newest", (12, "b"): "other"}
    got = {(r.k, r.part): r.v for r in table.read().collect()}
    assert got == want and table.read().count() == 102
    assert table.read().where("k = 11").first().at == 0  # an equal hash stays as it was


def test_an_unchanged_batch_makes_no_version(spark, table):
    n = table.versions()
    table.merge(made(spark, [(k, "a", f"v{k}", f"h{k}", 5) for k in range(30)]), [F.desc("at")], "h")
    assert table.versions() == n


def test_untouched_ranges_are_not_read(spark, table):
    plan = table.read(60, 70)._jdf.queryExecution().executedPlan().toString()
    assert {r.k for r in table.read(60, 70).collect()} == set(range(60, 71))
    opened = {f.rsplit("/", 1)[0] for f in table.read(60, 70).inputFiles()}
    assert len(opened) < len(table.files()) and "Exchange" not in plan


def test_compaction_splits_and_keeps_rows(spark, table):
    for n in range(4):
        table.merge(made(spark, [(k, f"p{n}", "w", f"{n}", n) for k in range(50, 75)]), [F.desc("at")])
    rows, before = content(table.read()), table.files()
    table.compact(4)
    after = table.files()
    assert content(table.read()) == rows and len(rows) == 201
    assert len(after) > len(before) and sum(before[k] == after.get(k) for k in before) >= len(before) - 2
    assert table.vacuum(1) > 0 and content(table.read()) == rows
    assert table.versions() == table.versions()[-1:]


def test_old_versions_read_as_they_were(spark, table):
    rows = content(table.read())
    table.merge(made(spark, [(5, "a", "changed", "c", 1)]), [F.desc("at")])
    assert content(table.read(version=0)) == rows != content(table.read())


def test_two_writers_cannot_take_one_number(spark, table):
    content_ = table.manifest()
    table._publish(dict(content_))
    with pytest.raises(Conflict):
        table._publish(dict(content_))
    with pytest.raises(Conflict):
        table.create(made(spark, []))


def test_random_merges_equal_a_dictionary(spark, tmp_path):
    rng = random.Random(4)
    t = RangeTable(spark, str(tmp_path / "t"), ["k", "part"], range_rows=15)
    truth = {(k, "a"): ("0", "0") for k in range(40)}
    t.create(made(spark, [(k, p, *x, 0) for (k, p), x in truth.items()]))
    for n in range(1, 5):
        batch = {(rng.choice([None, *range(-5, 60)]), rng.choice("ab")): (str(n), str(rng.randrange(2))) for _ in range(12)}
        t.merge(made(spark, [(k, p, *x, n) for (k, p), x in batch.items()]), [F.desc("at")], "h")
        for key, x in batch.items():
            if key not in truth or truth[key][1] != x[1]:
                truth[key] = x
        if n == 3:
            t.compact(2)
        assert {(r.k, r.part): (r.v, r.h) for r in t.read().collect()} == truth


def test_keys_of_text_and_dates_and_an_empty_table(spark, tmp_path):
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=k) for k in range(40)]
    t = RangeTable(spark, str(tmp_path / "d"), ["d"], range_rows=10)
    t.create(spark.createDataFrame([(x, 0) for x in days], "d date, v int"))
    t.merge(spark.createDataFrame([(days[3], 1), (dt.date(2023, 1, 1), 2)], "d date, v int"), [F.desc("v")])
    got = {r.d: r.v for r in t.read().collect()}
    assert got == {x: 0 for x in days} | {days[3]: 1, dt.date(2023, 1, 1): 2}
    assert t.read(days[30], days[32]).count() == 3
    e = RangeTable(spark, str(tmp_path / "e"), ["k"])
    e.create(spark.createDataFrame([], "k string, v int"))
    e.merge(spark.createDataFrame([("b", 1), ("a", 2), ("b", 3)], "k string, v int"), [F.desc("v")])
    assert content(e.read()) == [("a", 2), ("b", 3)]
    with pytest.raises(TypeError):
        RangeTable(spark, str(tmp_path / "ts"), ["k"]).create(spark.sql("SELECT current_timestamp() AS k"))


def test_a_repeated_micro_batch_changes_nothing(spark, tmp_path):
    t = RangeTable(spark, str(tmp_path / "t"), ["k"], range_rows=10)
    write = range_sink(t, [F.desc("at")], "h", deltas=2)
    write(made(spark, [(k, "", "a", f"{k}", 0) for k in range(30)]), 0)
    for _ in range(2):
        write(made(spark, [(3, "", "b", "x", 1)]), 1)
    n = t.versions()
    write(made(spark, [(3, "", "late", "y", 0)]), 1)
    assert t.versions() == n and t.read().where("k = 3").first().v == "b"


# ---- streams


def ended(spark, out, folder):
    out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out")


def live(spark, folder, parts, schema):
    """A stream of files, one a micro-batch, in the order given."""
    import os
    import time

    for k, rows in enumerate(parts):
        path = f"{folder}/p{k}"
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
        for f in os.listdir(path):
            os.utime(f"{path}/{f}", (time.time() - 1000 + 10 * k,) * 2)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(folder)


def test_episodes_end_and_do_not_depend_on_arrival(spark, tmp_path):
    rng = random.Random(2)
    start = dt.datetime(2024, 1, 1)
    rows = [(f"e{k}", start + dt.timedelta(days=d, hours=rng.randrange(24)), rng.random()) for k in range(6) for d in range(60)]
    order = sorted(rows, key=lambda r: r[1] + dt.timedelta(days=rng.uniform(0, 4)))  # late by up to four days
    schema = "e string, ts timestamp, s double"
    far = [("end", stateful.FAR, 1.0)]
    s = live(spark, f"{tmp_path}/in", [order[:120], order[120:240], order[240:], far, far], schema)
    got = ended(spark, stateful.episodes(s, "e", "ts", "s", 0.6, "5 days", 9), str(tmp_path)).where("e <> 'end'")
    days = spark.createDataFrame(rows, schema).withColumn("d", F.unix_date(F.to_date("ts"))).withColumn("days_to_failure", F.lit(None).cast("int"))
    want = events.episodes(days, "e", "d", "s", 0.6, 9)
    assert sorted((r.e, r.opened_day) for r in got.collect()) == sorted((r.e, r.day) for r in want.collect())
    state = spark.read.format("statestore").option("stateVarName", "free").load(f"{tmp_path}/state")
    assert {r.key[0] for r in state.select("key").collect()} <= {"end"}  # all others have ended


def test_sessions(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    at = [("a", 0), ("a", 20), ("a", 49), ("b", 5), ("a", 200), ("b", 36)]
    rows = [(k, start + dt.timedelta(minutes=m)) for k, m in at]
    s = live(spark, f"{tmp_path}/in", [rows[:3], rows[3:], [("end", stateful.FAR)]], "e string, ts timestamp")
    got = ended(spark, stateful.sessions(s, "e", "ts", "30 minutes", "6 hours"), str(tmp_path))
    minute = lambda t: int((t - start).total_seconds() // 60)
    assert sorted((r.e, minute(r.first_at), minute(r.last_at), r.n_events) for r in got.collect()) == [("a", 0, 49, 3), ("a", 200, 200, 1), ("b", 5, 5, 1), ("b", 36, 36, 1)]


def test_late_labels(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    day = lambda k, d: (k, start + dt.timedelta(days=d))
    t = live(spark, f"{tmp_path}/t", [[day("a", d) for d in range(0, 60, 10)] + [day("b", 3)], [("end", stateful.FAR)]], "e string, ts timestamp")
    f = live(spark, f"{tmp_path}/f", [[day("a", 45), day("a", 52)], [("end", stateful.FAR)]], "e string, failed timestamp")
    got = ended(spark, stateful.late_labels(t, f, "e", "ts", "failed", "10 days", 30), str(tmp_path))
    want = {("a", d): next((x - d for x in (45, 52) if 0 <= x - d <= 30), None) for d in range(0, 60, 10)} | {("b", 3): None}
    assert {(r.e, (r.ts - start).days): r.days_to_failure for r in got.where("e <> 'end'").collect()} == want
