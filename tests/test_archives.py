"""Archives, footers and copies on executors."""

import datetime as dt
import io
import zipfile

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tarnforge.sources import archives


def zipped(path, members):
    with zipfile.ZipFile(path, "w") as z:
        for name, text in members.items():
            z.writestr(name, text)


@pytest.fixture
def folder(tmp_path):
    zipped(tmp_path / "b.zip", {"x/20180102.csv": "k,v\n1,a\n2,\"b\nc\"\n", "x/20180101.csv": "k,v\n7,\n", "__MACOSX/20180103.csv": "", "x/.20180104.csv": "", "note.txt": "n"})
    (tmp_path / "sub").mkdir()
    zipped(tmp_path / "sub" / "a.zip", {"20190101.csv": "﻿k,v\n" + "".join(f"{i},é{i}\n" for i in range(5000))})
    zipped(tmp_path / ".hidden.zip", {"20180101.csv": "k,v\n0,0\n"})
    return str(tmp_path)


def test_members_with_lineage(spark, folder):
    got = archives.member_rows(spark, folder, ["k", "v"])
    small = sorted(tuple(r) for r in got.where("source_archive = 'b.zip'").collect())
    assert small == [("b.zip", "x/20180101.csv", 2, "20180101", "7", ""), ("b.zip", "x/20180102.csv", 2, "20180102", "1", "a"), ("b.zip", "x/20180102.csv", 3, "20180102", "2", "b\nc")]
    rest = {r.source_row: (r.k, r.v) for r in got.where("source_archive = 'a.zip'").collect()}
    assert rest == {i + 2: (str(i), f"é{i}") for i in range(5000)}


def test_tasks_of_members(spark, folder, monkeypatch):
    assert archives.member_rows(spark, folder, ["k", "v"]).rdd.getNumPartitions() == 2
    monkeypatch.setattr(archives, "BYTES", 1)
    reader = archives.ZipMembers({"path": folder, "expected": '["k", "v"]'}).reader(None)
    assert [(len(p.members), p.archive.rsplit("/", 1)[1]) for p in reader.partitions()] == [(1, "b.zip"), (1, "b.zip"), (1, "a.zip")]


def test_only_days_asked_for(spark, folder):
    got = archives.member_rows(spark, f"file:{folder}", ["k", "v"], days=["2018-01-01"])
    assert [tuple(r)[3:] for r in got.collect()] == [("20180101", "7", "")]


@pytest.mark.parametrize("text", ["k,w\n1,2\n", "k,k\n1,2\n", "k,v\n1\n", "k,v\n1,2,3\n", "k,v\n", ""])
def test_broken_members(spark, tmp_path, text):
    zipped(tmp_path / "a.zip", {"20180101.csv": text})
    with pytest.raises(Exception, match="contract|empty|20180101"):
        archives.member_rows(spark, str(tmp_path), ["k", "v"]).collect()


def test_names_without_a_date(spark, tmp_path):
    zipped(tmp_path / "a.zip", {"x.csv": "k\n1\n"})
    with pytest.raises(Exception, match="no date"):
        archives.member_rows(spark, str(tmp_path), ["k"]).collect()
    assert [r.k for r in archives.member_rows(spark, str(tmp_path), ["k"], dated=False).collect()] == ["1"]
    with pytest.raises(Exception, match="no member"):
        archives.member_rows(spark, str(tmp_path / "none"), ["k"]).collect()


def test_written_archives_read_back(spark, tmp_path):
    rows = [(f"a{k % 3}", f"2020010{k % 4 + 1}.csv", k, f"v,\"{k}\"\n") for k in range(400)]
    df = spark.createDataFrame(rows, "archive string, member string, k long, v string")
    archives.write_members(df.repartition(5), str(tmp_path / "z"), "archive", "member", ["k"])
    assert sorted(p.name for p in (tmp_path / "z").iterdir()) == ["a0.zip", "a1.zip", "a2.zip"]
    got = archives.member_rows(spark, str(tmp_path / "z"), ["k", "v"])
    assert sorted((r.source_archive, r.source_file, int(r.k), r.v) for r in got.collect()) == sorted((f"{a}.zip", m, k, v) for a, m, k, v in rows)
    assert got.groupBy("source_archive", "source_file").agg({"source_row": "max", "k": "count"}).where("`max(source_row)` <> `count(k)` + 1").count() == 0


def test_footers(spark, tmp_path):
    t = pa.table({"a": [1, None, 3, 4], "b": ["x", "y", None, None], "d": [dt.date(2024, 1, k + 1) for k in range(4)]})
    pq.write_table(t, tmp_path / "one.parquet", row_group_size=2)
    pq.write_table(t.slice(0, 1), tmp_path / "two.parquet", write_statistics=["a"])
    got = archives.footer_stats(spark, str(tmp_path))
    assert got.where("file LIKE '%one%' AND column_name = 'd'").orderBy("row_group").select("low", "high", "row_count").collect() == [("2024-01-01", "2024-01-02", 2), ("2024-01-03", "2024-01-04", 2)]
    nulls = {r.column_name: (r.row_count, r.null_count) for r in archives.footer_nulls(spark, str(tmp_path), ["a", "b"]).collect()}
    assert nulls == {"a": (5, 1), "b": (5, None)}  # one group of b has no statistics
    assert archives.footer_stats(spark, str(tmp_path / "none")).count() == 0


def half_at_first(source, attempt):
    content = open(source.removeprefix("file:"), "rb").read()
    return io.BytesIO(content[: len(content) // 2] if attempt == 0 else content)


def never(source, attempt):
    return io.BytesIO(b"PAR1 is not enough")


def test_copies_are_whole_or_not_there(spark, tmp_path):
    import hashlib

    pq.write_table(pa.table({"a": list(range(1000))}), tmp_path / "x.parquet")
    files = spark.createDataFrame([(str(tmp_path / "x.parquet"),)], "source string")
    row = archives.copy_whole(files, str(tmp_path / "to"), pause=0, opener=half_at_first).first()
    content = (tmp_path / "x.parquet").read_bytes()
    assert (row["file"], row["sha256"]) == ("x.parquet", hashlib.sha256(content).hexdigest()) and (tmp_path / "to" / "x.parquet").read_bytes() == content
    with pytest.raises(Exception, match="no whole Parquet"):
        archives.copy_whole(files, str(tmp_path / "bad"), pause=0, opener=never).collect()
    assert list((tmp_path / "bad").iterdir()) == []
