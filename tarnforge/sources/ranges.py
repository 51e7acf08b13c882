"""A table in key ranges, whose merges write only to the ranges that a batch falls into.

The table is a manifest beside folders of Parquet. A manifest names each range with its lowest key, the
folder of its base rows and the folders of its deltas in the order of their merges. A merge deals the batch by range,
compares it with the rows of those ranges, and writes the changed and new rows of each as one more delta: files of
untouched ranges keep their names and are not read. Readers take base rows as they are where a range has
no deltas, and elsewhere the last version of each key. ``compact`` rewrites ranges of many deltas, and splits
those that have grown.

Manifests are numbered. Each is written beside its place and takes it at the end, and the next number can be taken
once, so that of two writers at a time one fails and no reader sees half a merge. A batch may carry a
number (a stream's epoch): one that is not larger than the last merged is done already and left out.
Files that no kept manifest names are removed by ``vacuum``.

Keys: ranges are of the first key column, null before all others, and of numbers, text or dates; rows are unique by all key columns. The driver
holds the list of ranges, some hundred bytes each.
"""

from __future__ import annotations

import json
import uuid
from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnforge.functions.lineage import cut, remove
from tarnforge.operators.merge import dedup_latest

RANGE_ROWS, DELTAS = 4_000_000, 4
_SEQ, _RANGE = "_merge", "_range"


class Conflict(RuntimeError):
    """Another writer took the manifest's number."""


class RangeTable:
    def __init__(self, spark: SparkSession, root: str, keys: list[str], range_rows: int = RANGE_ROWS):
        self.spark, self.root, self.keys, self.range_rows = spark, root.rstrip("/"), keys, range_rows

    # ---- manifests

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def versions(self) -> list[int]:
        fs, at = self._fs(f"{self.root}/manifests")
        names = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(int(n) for n in names if n.isdigit())

    def manifest(self, version: int | None = None) -> dict:
        last = version if version is not None else self.versions()[-1]
        return json.loads(self.spark.read.text(f"{self.root}/manifests/{last:010d}", wholetext=True).first()[0])

    def _publish(self, content: dict) -> dict:
        content["version"] = content.get("version", -1) + 1
        fs, part = self._fs(f"{self.root}/manifests/.{uuid.uuid4().hex}")
        place = self._fs(f"{self.root}/manifests/{content['version']:010d}")[1]
        out = fs.create(part, False)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        if fs.exists(place) or not fs.rename(part, place):
            fs.delete(part, False)
            raise Conflict(f"version {content['version']} is taken")
        return content

    # ---- ranges

    def _split(self, df: DataFrame, n: int) -> list[dict]:
        """Writes rows as ``n`` ranges and returns their entries, without the lowest keys' order."""
        folder = f"data/{uuid.uuid4().hex}"
        key = F.col(self.keys[0])
        dealt = df.repartitionByRange(max(1, n), key.asc_nulls_first()).withColumn(_RANGE, F.spark_partition_id())
        dealt.write.partitionBy(_RANGE).parquet(f"{self.root}/{folder}")
        written = self.spark.read.schema(T.StructType([*df.schema.fields, T.StructField(_RANGE, T.IntegerType())])).parquet(f"{self.root}/{folder}")
        found = written.groupBy(_RANGE).agg(F.min(key).alias("low"), F.count("*").alias("n"), F.count(key).alias("known")).orderBy("low").collect()  # a row a range
        return [{"low": None if r["known"] < r["n"] else _plain(r["low"]), "rows": r["n"], "base": f"{folder}/{_RANGE}={r[_RANGE]}", "deltas": []} for r in found]

    def create(self, df: DataFrame) -> dict:
        """A new table of rows unique by the keys."""
        if self.versions():
            raise Conflict("the table is there")
        if isinstance(df.schema[self.keys[0]].dataType, (T.TimestampType, T.TimestampNTZType)):
            raise TypeError("ranges are of numbers, text or dates")
        df = cut(df)
        ranges = self._split(df, -(-df.count() // self.range_rows))
        for r in ranges[:1]:
            r["low"] = None  # the first range takes all lower keys
        if not ranges:
            ranges = [{"low": None, "rows": 0, "base": None, "deltas": []}]
        return self._publish({"schema": json.loads(df.schema.json()), "batch": None, "ranges": ranges})

    def _numbered(self, df: DataFrame, ranges: list[dict]) -> DataFrame:
        """The rows with the number of their range: the last whose lowest key is not above theirs."""
        kind = df.schema[self.keys[0]].dataType
        lows = [_typed(r["low"], kind) for r in ranges[1:]]

        @F.pandas_udf("int")
        def number(key: pd.Series) -> pd.Series:
            return pd.Series([0 if k is None or k != k else bisect_right(lows, _comparable(k, kind)) for k in key], dtype="int32")

        return df.withColumn(_RANGE, number(self.keys[0]))

    # ---- reading

    def _rows(self, content: dict, ranges: list[dict], numbered: bool = False) -> DataFrame:
        schema = T.StructType.fromJson(content["schema"])
        read = lambda folders: self.spark.read.schema(schema).parquet(*[f"{self.root}/{f}" for f in folders])
        clean = [r["base"] for r in ranges if r["base"] and not r["deltas"]]
        out = read(clean) if clean else self.spark.createDataFrame([], schema)
        dirty = [r for r in ranges if r["deltas"]]
        if dirty:
            parts: dict[int, list[str]] = {}
            for r in dirty:
                for k, f in enumerate([r["base"], *r["deltas"]]):
                    if f:
                        parts.setdefault(k, []).append(f)
            every = None
            for k, folders in sorted(parts.items()):
                part = read(folders).withColumn(_SEQ, F.lit(k))
                every = part if every is None else every.unionByName(part)
            out = out.unionByName(dedup_latest(every, self.keys, [F.desc(_SEQ)]).drop(_SEQ))
        return out

    def read(self, low=None, high=None, version: int | None = None) -> DataFrame:
        """The table, or its rows with first keys from ``low`` to ``high``, of which only the ranges in question are opened."""
        content = self.manifest(version)
        ranges, kind = content["ranges"], T.StructType.fromJson(content["schema"])[self.keys[0]].dataType
        lows = [_typed(r["low"], kind) for r in ranges[1:]]
        first = bisect_right(lows, _comparable(low, kind)) if low is not None else 0
        last = bisect_right(lows, _comparable(high, kind)) if high is not None else len(ranges) - 1
        out, key = self._rows(content, ranges[first : last + 1]), F.col(self.keys[0])
        return out.where((key >= F.lit(low) if low is not None else F.lit(True)) & (key <= F.lit(high) if high is not None else F.lit(True)))

    # ---- merging

    def merge(self, batch: DataFrame, order: list[Column], hash_col: str | None = None, number: int | None = None) -> dict:
        """Upserts a batch, of which the first row a key in ``order`` counts. With ``hash_col`` rows whose hash is that of
        the table's row stay as they are. Returns the new manifest (or the present one if there is nothing to do)."""
        content = self.manifest()
        if number is not None and content["batch"] is not None and number <= content["batch"]:
            return content
        columns = [f["name"] for f in content["schema"]["fields"]]
        fresh = cut(self._numbered(dedup_latest(batch, self.keys, order).select(*columns), content["ranges"]))
        touched = sorted(r[_RANGE] for r in fresh.select(_RANGE).distinct().collect())  # a row a range
        if hash_col and touched:
            present = self._rows(content, [content["ranges"][k] for k in touched])
            on = [F.col(f"f.{k}").eqNullSafe(F.col(f"p.{k}")) for k in self.keys]
            fresh = cut(fresh.alias("f").join(present.select(*self.keys, hash_col).alias("p"), [*on, F.col(f"f.{hash_col}").eqNullSafe(F.col(f"p.{hash_col}"))], "left_anti"))
            touched = sorted(r[_RANGE] for r in fresh.select(_RANGE).distinct().collect())
        if touched:
            folder = f"data/{uuid.uuid4().hex}"
            fresh.repartition(_RANGE).write.partitionBy(_RANGE).parquet(f"{self.root}/{folder}")
            for k in touched:
                content["ranges"][k]["deltas"].append(f"{folder}/{_RANGE}={k}")
        elif number is None:
            return content
        if number is not None:
            content["batch"] = number
        return self._publish(content)

    def compact(self, deltas: int = DELTAS) -> dict:
        """Rewrites the ranges of ``deltas`` or more merges, each as one range or as several if it has grown."""
        content = self.manifest()
        ranges = []
        for r in content["ranges"]:
            if len(r["deltas"]) < deltas:
                ranges.append(r)
                continue
            rows = cut(self._rows(content, [r]))
            new = self._split(rows, round(rows.count() / self.range_rows) or 1)
            new[0]["low"] = r["low"]
            ranges += new
        if ranges == content["ranges"]:
            return content
        return self._publish({**content, "ranges": ranges})

    def vacuum(self, keep: int = 2) -> int:
        """Removes manifests but the last ``keep`` and the folders that only they name; returns how many folders."""
        known = self.versions()
        named = [{f for r in self.manifest(v)["ranges"] for f in [r["base"], *r["deltas"]] if f} for v in known]
        stay, gone = set().union(*named[-keep:]), set().union(*named[:-keep])
        for f in gone - stay:
            remove(self.spark, f"{self.root}/{f}")
        for v in known[:-keep]:
            remove(self.spark, f"{self.root}/manifests/{v:010d}")
        return len(gone - stay)

    def files(self, version: int | None = None) -> dict[str, list[str]]:
        """Base folder and deltas of each range by its lowest key."""
        return {str(r["low"]): [f for f in [r["base"], *r["deltas"]] if f] for r in self.manifest(version)["ranges"]}


def _plain(x):
    return x if isinstance(x, (int, float, str)) or x is None else x.isoformat() if hasattr(x, "isoformat") else str(x)


def _comparable(x, kind: T.DataType):
    """A key as a value that sorts: numbers, text, and dates as days' numbers."""
    if isinstance(kind, T.DateType):
        return pd.Timestamp(x).toordinal()
    return x.item() if isinstance(x, np.generic) else x


def _typed(x, kind: T.DataType):
    from decimal import Decimal

    return Decimal(x) if isinstance(kind, T.DecimalType) and x is not None else _comparable(x, kind) if x is not None else x


def range_sink(table: RangeTable, order: list[Column], hash_col: str | None = None, deltas: int = DELTAS):
    """A foreachBatch function: each micro-batch is merged by its epoch, so that a repeated one changes nothing, and
    ranges of many deltas are rewritten."""
    def write(batch: DataFrame, epoch: int) -> None:
        if table.versions():
            table.merge(batch, order, hash_col, epoch)
            table.compact(deltas)
        else:
            table.create(dedup_latest(batch, table.keys, order))
            table._publish({**table.manifest(), "batch": epoch})

    return write
