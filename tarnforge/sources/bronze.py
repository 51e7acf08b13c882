"""Raw ingestion with lineage: ZIP members, CSV with a header contract, Parquet with file metadata."""

from __future__ import annotations

import datetime as dt
import hashlib
import os
import re
import time
import zipfile
from collections.abc import Callable
from itertools import groupby
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_DATED = re.compile(r"(\d{8})\.csv$", re.IGNORECASE)


class SourceError(ValueError):
    """An input breaks its contract."""


def eligible_members(archive: str, dated: bool = True) -> list[tuple[str | None, str]]:
    """(day, member) of the CSV members in order; hidden and resource-fork entries are skipped. With
    ``dated`` a name without a valid YYYYMMDD is an error."""
    out = []
    with zipfile.ZipFile(archive) as z:
        for name in sorted(z.namelist()):
            parts = PurePosixPath(name).parts
            if name.endswith("/") or not name.lower().endswith(".csv") or any(p.startswith(".") or p == "__MACOSX" for p in parts):
                continue
            day = None
            if dated:
                m = _DATED.search(name)
                try:
                    day = dt.datetime.strptime(m.group(1), "%Y%m%d").date().isoformat()
                except (AttributeError, ValueError) as e:
                    raise SourceError(f"{name} has no date") from e
            out.append((day, name))
    return sorted(out, key=lambda x: (x[0] or "", x[1]))


def plan_loads(days: list[str], start: str, end: str, most: int = 6) -> list[dict]:
    """Days in range by month, months paired so that there are at most ``most`` loads."""
    chosen = sorted(d for d in set(days) if start <= d <= end)
    if not chosen:
        raise SourceError("no day in the range")
    months = [list(g) for _, g in groupby(chosen, key=lambda d: d[:7])]
    size = max(2, -(-len(months) // most)) if len(months) > 1 else 1
    groups = [sum(months[i : i + size], []) for i in range(0, len(months), size)]
    return [{"id": f"{g[0][:7]}..{g[-1][:7]}", "dates": g} for g in groups]


def check_header(header: str, expected: list[str]) -> None:
    got = [h.strip().strip('"') for h in header.lstrip("﻿").rstrip("\r\n").split(",")]
    if len(set(got)) != len(got) or "" in got or got != list(expected):
        raise SourceError("the header differs from the contract")


def read_csv(spark: SparkSession, path: str, expected: list[str], archive: str = "") -> DataFrame:
    """Strings with lineage: source_archive, source_file, source_row (line number, the header is 1).

    The header is compared first; a row of another arity fails the read. Line numbers are the
    rank of a row in its file: rows keep file order in the scan, so the number comes from the counts of
    the splits before it and needs no global sort.
    """
    check_header(spark.read.text(path).first()[0], expected)
    schema = ", ".join(f"`{c}` string" for c in expected)
    raw = spark.read.csv(path, schema=schema, header=True, mode="FAILFAST", nullValue="", encoding="UTF-8", enforceSchema=True)
    raw = raw.select(F.lit(archive).alias("source_archive"), F.col("_metadata.file_name").alias("source_file"), F.col("_metadata.file_block_start").alias("_block"), "*").withColumn("_at", F.monotonically_increasing_id())
    first = raw.groupBy("source_file", "_block").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))  # one row a split
    from pyspark.sql import Window

    ahead = F.coalesce(F.sum("_n").over(Window.partitionBy("source_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = first.select("source_file", "_block", "_first", ahead.alias("_ahead"))
    out = raw.join(first, ["source_file", "_block"]).withColumn("source_row", F.col("_at") - F.col("_first") + F.col("_ahead") + 2)
    return out.select("source_archive", "source_file", "source_row", *expected)


def extract_member(archive: str, member: str, expected: list[str], destination: str) -> int:
    """One CSV member to a CSV with lineage columns before its own, streamed; returns its rows."""
    import csv
    import io

    day = (_DATED.search(member) or [None, ""])[1]
    rows = 0
    with zipfile.ZipFile(archive) as z, z.open(member) as f, open(destination, "w", encoding="utf-8", newline="") as out:
        reader = csv.reader(io.TextIOWrapper(f, "utf-8", errors="strict", newline=""))
        writer = csv.writer(out)
        check_header(",".join(next(reader, [])), expected)
        writer.writerow(["source_archive", "source_file", "source_row", "source_date", *expected])
        for rows, row in enumerate(reader, 1):
            if len(row) != len(expected):
                raise SourceError(f"{member}: line {rows + 1} has {len(row)} values")
            writer.writerow([PurePosixPath(archive).name, member, rows + 1, day, *row])
    if not rows:
        raise SourceError(f"{member} is empty")
    return rows


def read_parquet(spark: SparkSession, path: str, month: str) -> DataFrame:
    """A monthly file as raw records: lineage and a VARIANT of each row, nulls kept."""
    df = spark.read.parquet(path)
    record = F.parse_json(F.to_json(F.struct(*[F.col(c) for c in df.columns]), {"ignoreNullFields": "false"}))
    return df.select(
        F.lit(month).alias("source_month"), F.col("_metadata.file_name").alias("source_file"), (F.col("_metadata.row_index") + 1).alias("source_row_number"),
        F.concat_ws("-", F.col("_metadata.file_size"), F.unix_millis(F.col("_metadata.file_modification_time"))).alias("source_content_key"), record.alias("raw_record"), F.current_timestamp().alias("loaded_at"),
    )


def parquet_envelope(path: str) -> str:
    """SHA-256 of a local file that begins and ends as Parquet does, or an error."""
    h = hashlib.sha256()
    with open(path, "rb") as f:
        head = f.read(4)
        h.update(head)
        last = head
        while chunk := f.read(1 << 20):
            h.update(chunk)
            last = (last + chunk)[-4:]
        size = f.tell()
    if head != b"PAR1" or last != b"PAR1" or size < 12:
        raise SourceError(f"{path} is no Parquet file")
    return h.hexdigest()


def fetch(open_source: Callable, destination: str, attempts: int | None = 3, pause: float = 1.0) -> str:
    """A local copy of a Parquet file that is there as a whole or not at all: the bytes of ``open_source()``
    go to a file beside the destination, which takes its name once its envelope is sound. Failed
    attempts are repeated, without bound for None. Returns the SHA-256."""
    part, tried = f"{destination}.part", 0
    while True:
        tried += 1
        try:
            with open_source() as source, open(part, "wb") as out:
                while chunk := source.read(1 << 20):
                    out.write(chunk)
            digest = parquet_envelope(part)
            os.replace(part, destination)
            return digest
        except (OSError, SourceError):
            if os.path.exists(part):
                os.remove(part)
            if attempts is not None and tried >= attempts:
                raise
            time.sleep(pause)


def read_seed(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A small CSV with a quoted header."""
    return spark.read.csv(path, header=True, quote='"', schema=schema)


class GuardError(ValueError):
    """A query is not allowed or returns too much."""


def query_small(spark: SparkSession, sql: str, most: int = 10_000) -> list:
    """One SELECT or WITH whose result is at most ``most`` rows; never collects more than one beyond."""
    text = sql.strip().rstrip(";").strip()
    if ";" in text or not re.match(r"(?is)^(select|with)\b", text):
        raise GuardError("a single SELECT or WITH is allowed")
    rows = spark.sql(text).limit(most + 1).collect()
    if len(rows) > most:
        raise GuardError(f"more than {most} rows")
    return rows


def identifier(name: str) -> str:
    """A safe identifier, quoted part by part."""
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_$]*(\.[A-Za-z_][A-Za-z0-9_$]*){0,2}", name):
        raise GuardError(f"bad identifier {name!r}")
    return ".".join(f"`{p}`" for p in name.split("."))
