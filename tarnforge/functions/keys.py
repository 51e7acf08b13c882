"""Deterministic keys and hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def joined(*cols: Column, sep: str = "|") -> Column:
    """Null if any part is null; ``concat_ws`` alone would skip it."""
    parts = [c.cast("string") for c in cols]
    out = parts[0]
    for p in parts[1:]:
        out = F.concat(out, F.lit(sep), p)
    return out


def surrogate_key(*cols: Column) -> Column:
    """SHA-256 of the pipe-joined business key; null if a part is null."""
    return F.sha2(joined(*cols), 256)


def content_hash(*cols: str) -> Column:
    """SHA-256 of the JSON of a record, null fields included."""
    return F.sha2(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}), 256)


def date_key(d: Column) -> Column:
    """YYYYMMDD as a whole number."""
    return (F.year(d) * 10000 + F.month(d) * 100 + F.dayofmonth(d)).cast("int")


def hash_bucket(key: Column, buckets: int, seed: str = "") -> Column:
    """0 to buckets - 1 from the md5 of the key: the same in every engine, unlike ``hash``."""
    digest = F.md5(F.concat(key.cast("string"), F.lit(seed)).cast("binary"))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % buckets).cast("int")


def epoch_day(d: Column) -> Column:
    return F.datediff(d.cast("date"), F.lit("1970-01-01").cast("date"))
