"""Archives, footers and file copies on executors, by data sources of Spark's Python API.

``member_rows`` reads the CSV members of ZIP archives, some members a task; ``write_members`` writes a
table as archives, an archive a group of rows; ``footer_stats`` reads the statistics of Parquet footers,
some files a task, and no column of data; ``copy_whole`` copies files whole or not at all. The driver
only lists names. Files are opened through Arrow's file systems (a plain path, file, hdfs, s3, gs),
so the folder must be one that all executors reach.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import PurePosixPath

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from tarnforge.sources import bronze
from tarnforge.sources.bronze import SourceError

LINEAGE = ["source_archive", "source_file", "source_row", "source_date"]
#: Footers and bytes of members that one task reads, about.
FILES, BYTES = 64, 16 << 20


def file_system(path: str):
    """Arrow's file system of a path, and the path in it. ``file:/x`` is taken as ``file:///x``."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path)


def listed(path: str, ending: str) -> list[str]:
    """Files below a path (or the path itself), without hidden ones, in order."""
    from pyarrow import fs

    system, at = file_system(path)
    info = system.get_file_info(at)
    if info.type == fs.FileType.File:
        return [at]
    found = system.get_file_info(fs.FileSelector(at, recursive=True, allow_not_found=True))
    below = [(f.path, PurePosixPath(f.path[len(at) :].lstrip("/")).parts) for f in found if f.type == fs.FileType.File]
    return sorted(p for p, parts in below if p.lower().endswith(ending) and not any(x.startswith((".", "_")) for x in parts))


def prefix(path: str) -> str:
    """What to put before a listed path to open it again."""
    return f"{path.split(':', 1)[0]}://" if ":" in path and not path.startswith("file:") else ""


class _Members(InputPartition):
    def __init__(self, archive: str, members: list[tuple[str, str | None]]):
        super().__init__((archive, members))
        self.archive, self.members = archive, members


class _MemberReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.expected = options["path"], json.loads(options["expected"])
        self.dated, self.days = options.get("dated", "true") == "true", options.get("days")

    def partitions(self) -> list[_Members]:
        """The eligible members, by the archives' directories, in tasks of about ``BYTES`` of text; a larger member is a task's
        own, as a member is one stream. Only days asked for are read."""
        wanted = None if self.days is None else set(json.loads(self.days))
        out = []
        for archive in (prefix(self.path) + a for a in listed(self.path, ".zip")):
            system, at = file_system(archive)
            with system.open_input_file(at) as f:
                members = [(name, day) for day, name in bronze.eligible_members(f, self.dated) if wanted is None or day in wanted]
                sizes = {i.filename: i.file_size for i in zipfile.ZipFile(f).infolist()} if members else {}
            held, size = [], 0
            for m in members:
                if held and size + sizes[m[0]] > BYTES:
                    out.append(_Members(archive, held))
                    held, size = [], 0
                held, size = [*held, m], size + sizes[m[0]]
            if held:
                out.append(_Members(archive, held))
        if not out:
            raise SourceError(f"no member to read below {self.path}")
        return out

    def read(self, part: _Members) -> Iterator[pa.RecordBatch]:
        system, at = file_system(part.archive)
        with system.open_input_file(at) as f, zipfile.ZipFile(f) as z:
            for name, day in part.members:
                with z.open(name) as raw:
                    yield from self._rows(PurePosixPath(part.archive).name, name, day, raw)

    def _rows(self, archive: str, member: str, day: str | None, raw) -> Iterator[pa.RecordBatch]:
        """The member streamed: its header is compared, and a row of another arity or an empty member is an error."""
        from pyarrow import csv

        bronze.check_header(raw.readline().decode("utf-8"), self.expected)
        text, done = pa.string(), 0
        options = csv.ReadOptions(column_names=self.expected, block_size=1 << 22), csv.ParseOptions(newlines_in_values=True), csv.ConvertOptions(column_types=dict.fromkeys(self.expected, text), strings_can_be_null=False)
        try:
            for b in csv.open_csv(raw, *options):
                n = b.num_rows
                lineage = [pa.array([x] * n, text) for x in (archive, member, (day or "").replace("-", ""))]
                yield pa.RecordBatch.from_arrays([*lineage[:2], pa.array(range(done + 2, done + n + 2), pa.int64()), lineage[2], *b.columns], [*LINEAGE, *self.expected])
                done += n
        except pa.ArrowInvalid as e:
            if "Empty CSV" not in str(e):
                raise SourceError(f"{member}: {e}") from e
        if not done:
            raise SourceError(f"{member} is empty")


class _Archive(WriterCommitMessage):
    def __init__(self, moves: list[tuple[str, str]]):
        self.moves = moves


class _MemberWriter(DataSourceArrowWriter):
    """Rows that come in the order of (archive, member) become ``archive``.zip files with CSV members. An archive is
    written beside its place and takes it when all tasks are done, so that a failed or repeated task leaves none."""

    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def write(self, batches: Iterator[pa.RecordBatch]) -> _Archive:
        from pyarrow import csv

        system, root = file_system(self.path)
        moves, archive, member, out, z, f = [], None, None, None, None, None
        for b in batches:
            names = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
            at = 0
            while at < len(names):
                end = at
                while end < len(names) and names[end] == names[at]:
                    end += 1
                if names[at][0] != archive:
                    if z:
                        f.close(), z.close(), out.close()
                    archive, member = names[at][0], None
                    moves.append((f"{root}/.{archive}-{uuid.uuid4().hex}", f"{root}/{archive}.zip"))
                    system.create_dir(root, recursive=True)
                    out = system.open_output_stream(moves[-1][0])
                    z, f = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED), None
                fresh = names[at][1] != member
                if fresh:
                    if f:
                        f.close()
                    member = names[at][1]
                    f = z.open(zipfile.ZipInfo(member, (1980, 1, 1, 0, 0, 0)), "w", force_zip64=True)
                rows = pa.RecordBatch.from_arrays(b.columns[2:], b.schema.names[2:]).slice(at, end - at)
                buffer = pa.BufferOutputStream()
                csv.write_csv(rows, buffer, csv.WriteOptions(include_header=fresh, quoting_style="needed"))
                f.write(buffer.getvalue())
                at = end
        if z:
            f.close(), z.close(), out.close()
        return _Archive(moves)

    def commit(self, messages: list) -> None:
        system, root = file_system(self.path)
        system.create_dir(root, recursive=True)
        for m in messages:
            for part, whole in m.moves if m else []:
                system.move(part, whole)

    def abort(self, messages: list) -> None:
        system, _ = file_system(self.path)
        for m in messages:
            for part, _ in m.moves if m else []:
                system.delete_file(part)


class ZipMembers(DataSource):
    """Format ``zip_members``. Options: path, expected (JSON list of columns), dated, days (JSON list of ISO days)."""

    @classmethod
    def name(cls) -> str:
        return "zip_members"

    def schema(self) -> str:
        return ", ".join([*[f"{c} {'long' if c == 'source_row' else 'string'}" for c in LINEAGE], *[f"`{c}` string" for c in json.loads(self.options["expected"])]])

    def reader(self, schema) -> _MemberReader:
        return _MemberReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> _MemberWriter:
        return _MemberWriter(self.options["path"])


class _Files(InputPartition):
    def __init__(self, files: list[str]):
        super().__init__(files)
        self.files = files


class _FooterReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[_Files]:
        files = [prefix(self.path) + f for f in listed(self.path, ".parquet")]
        return [_Files(files[k : k + FILES]) for k in range(0, len(files), FILES)] or [_Files([])]

    def read(self, part: _Files) -> Iterator[tuple]:
        import pyarrow.parquet as pq

        for name in part.files:
            system, at = file_system(name)
            with system.open_input_file(at) as f:
                meta = pq.read_metadata(f)
            for g in range(meta.num_row_groups):
                group = meta.row_group(g)
                for i in range(meta.num_columns):
                    c = group.column(i)
                    s = c.statistics
                    nulls = s.null_count if s is not None and s.has_null_count else None
                    low, high = (None, None) if s is None or not s.has_min_max else (_text(s.min), _text(s.max))
                    yield name, g, c.path_in_schema, group.num_rows, nulls, low, high, c.total_compressed_size


def _text(x) -> str | None:
    return x.isoformat() if isinstance(x, dt.date) else str(x) if isinstance(x, (int, float, str, bool)) else None


class ParquetFooters(DataSource):
    """Format ``parquet_footers``: a row for each column of each row group. Option: path."""

    @classmethod
    def name(cls) -> str:
        return "parquet_footers"

    def schema(self) -> str:
        return "file string, row_group int, column_name string, row_count long, null_count long, low string, high string, n_bytes long"

    def reader(self, schema) -> _FooterReader:
        return _FooterReader(self.options["path"])


def register(spark: SparkSession) -> None:
    for source in (ZipMembers, ParquetFooters):
        spark.dataSource.register(source)


def member_rows(spark: SparkSession, path: str, expected: list[str], dated: bool = True, days: list[str] | None = None) -> DataFrame:
    """Lineage (archive, member, line, date of the name) and the columns as strings, of all eligible members below a
    path; with ``days`` (ISO) of those days only."""
    register(spark)
    r = spark.read.format("zip_members").option("expected", json.dumps(expected)).option("dated", str(dated).lower())
    return (r if days is None else r.option("days", json.dumps(days))).load(path)


def write_members(df: DataFrame, path: str, archive: str, member: str, order: list[str]) -> None:
    """A ZIP for each value of ``archive``, with a CSV for each of ``member``, in ``order``; other columns are the CSV's.
    One archive is one task's, as archives are one stream."""
    register(df.sparkSession)
    cols = [c for c in df.columns if c not in (archive, member)]
    rows = df.repartition(F.col(archive)).sortWithinPartitions(archive, member, *order).select(archive, member, *cols)
    rows.write.format("zip_members").option("expected", json.dumps(cols)).mode("append").save(path)


def footer_stats(spark: SparkSession, path: str) -> DataFrame:
    """file, row_group, column_name, row_count, null_count, low, high, n_bytes from the footers of Parquet files."""
    register(spark)
    return spark.read.format("parquet_footers").load(path)


def footer_nulls(spark: SparkSession, path: str, cols: list[str]) -> DataFrame:
    """column_name, row_count, null_count without reading a column; null where a row group has no statistics."""
    g = footer_stats(spark, path).where(F.col("column_name").isin(cols)).groupBy("column_name")
    return g.agg(F.sum("row_count").alias("row_count"), F.when(F.count("null_count") == F.count("*"), F.sum("null_count")).alias("null_count"))


def copy_whole(files: DataFrame, destination: str, attempts: int = 3, pause: float = 1.0, opener: Callable | None = None) -> DataFrame:
    """``(source)`` to source, file, sha256: Parquet files copied by executors into a folder. A copy takes its name once
    its envelope is sound; failed attempts are repeated. ``opener(source, attempt)`` opens a source."""
    target = destination.rstrip("/")

    def run(batches):
        for b in batches:
            for source in b.column(0).to_pylist():
                system, root = file_system(target)
                system.create_dir(root, recursive=True)
                name, digest = PurePosixPath(source).name, _copied(source, system, root, attempts, pause, opener or _opened)
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (source, name, digest)], ["source", "file", "sha256"])

    return files.select("source").mapInArrow(run, "source string, file string, sha256 string")


def _opened(source: str, attempt: int):
    system, at = file_system(source)
    return system.open_input_stream(at)


def _copied(source: str, system, root: str, attempts: int, pause: float, opener: Callable) -> str:
    import hashlib
    import time

    part, whole = f"{root}/.{uuid.uuid4().hex}.part", f"{root}/{PurePosixPath(source).name}"
    for attempt in range(attempts):
        try:
            h, head, last, size = hashlib.sha256(), b"", b"", 0
            with opener(source, attempt) as f, system.open_output_stream(part) as out:
                while chunk := f.read(1 << 20):
                    out.write(chunk)
                    h.update(chunk)
                    head, last, size = (head + chunk[:4])[:4], (last + chunk)[-4:], size + len(chunk)
            if head != b"PAR1" or last != b"PAR1" or size < 12:
                raise SourceError(f"{source} is no whole Parquet file")
            system.move(part, whole)
            return h.hexdigest()
        except (OSError, SourceError):
            if attempt + 1 == attempts:
                raise
            time.sleep(pause)
        finally:
            from pyarrow import fs

            if system.get_file_info(part).type == fs.FileType.File:
                system.delete_file(part)
