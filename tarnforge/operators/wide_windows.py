"""Calendar-range features of very many columns in one vectorised pass.

``windows.rolling`` states the same with Spark's windows. Of hundreds of them each row recomputes each
frame, interpreted; here an Arrow function sees the rows of a partition in (entity, day) order, takes
running sums of all columns at once, and a frame costs two lookups in them. Sums are exact: values are
whole numbers of millionths, added as such in parts of 32 bits.

A batch is worked on with the rows of its last entity that later frames can still reach, so that an
entity of any length needs the memory of a batch and of two windows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that are worked on at a time, at least.
ROWS = 8192
_SCALE, _KIND = 10**6, "decimal(38,6)"
_NO_DAY = -(1 << 30)
_LOW = np.int64(0xFFFFFFFF)


def _parts(c: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """Which values are there, and the millionths of all (0 if not) as numbers whose weights are 2**0, 2**32 and 2**64."""
    there = np.asarray(c.is_valid())
    raw = np.frombuffer(c.buffers()[1], dtype="<i8").reshape(-1, 2)[c.offset : c.offset + len(c)]
    low, high = np.where(there, raw[:, 0], 0), np.where(there, raw[:, 1], 0)
    if (high == low >> 63).all() and (not len(low) or max(abs(int(low.min())), abs(int(low.max()))) < (1 << 62) // max(len(low), 1)):
        return there, [low]  # no sum of these leaves 64 bits
    return there, [low & _LOW, (low >> 32) & _LOW, high]


def _sums(parts: list[np.ndarray], bounds: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """The sum of each frame as a float, rounded once."""
    running = [np.concatenate([[0], np.cumsum(p)]) for p in parts]
    out = []
    for a, b in bounds:
        got = [r[b] - r[a] for r in running]
        if len(got) == 1:
            out.append(got[0].astype(float))
            continue
        got[1] += got[0] >> 32
        got[2] += got[1] >> 32
        low = (got[1] << 32) | (got[0] & _LOW)
        small = got[2] == low >> 63  # the sum itself is of 64 bits
        size = np.where(got[2] < 0, -1.0, 1.0)
        # Of a negative number the parts of its size, so that nothing is cancelled.
        lo, mid, hi = got[0] & _LOW, got[1] & _LOW, got[2]
        lo, mid, hi = np.where(size < 0, ~lo & _LOW, lo), np.where(size < 0, ~mid & _LOW, mid), np.where(size < 0, ~hi, hi)
        out.append(np.where(small, low.astype(float), size * (hi * 2.0**64 + (mid * 2.0**32 + lo + (size < 0)))))
    return out


def family(n: int) -> list[str]:
    return [f"{p}_{n}D" for p in ("MEAN", "COUNT", "PREV_COUNT", "MEAN_VALID", "MEAN_SHIFT", "MEAN_SHIFT_VALID")]


def _features(columns: list[pa.Array], segment: np.ndarray, day: np.ndarray, windows: tuple[int, ...], keep: np.ndarray) -> list[list[pa.Array]]:
    """Of each column the features by name, of the rows ``keep`` of sorted rows."""
    at = segment * (1 << 33) + day
    known = day > _NO_DAY
    find = lambda x, side: np.searchsorted(at, x, side)
    peers = find(at, "left")[keep], find(at, "right")[keep]  # rows without a day see each other only
    has_day = known[keep]
    frames = []
    for n in windows:
        now = np.where(has_day, find(at - (n - 1), "left")[keep], peers[0]), peers[1]
        before = np.where(has_day, find(at - (2 * n - 1), "left")[keep], peers[0]), np.where(has_day, find(at - n, "right")[keep], peers[1])
        frames += [now, before]
    out = []
    for c in columns:
        there, parts = _parts(c)
        counts = np.concatenate([[0], np.cumsum(there)])
        n_in, sums, made = [counts[b] - counts[a] for a, b in frames], _sums(parts, frames), {}
        for k, n in enumerate(windows):
            (n1, n0), (s1, s0) = n_in[2 * k : 2 * k + 2], sums[2 * k : 2 * k + 2]
            mean, last = s1 / np.maximum(n1, 1) / _SCALE, s0 / np.maximum(n0, 1) / _SCALE
            both = (n1 > 0) & (n0 > 0)
            values = [pa.array(mean, mask=n1 == 0), pa.array(n1), pa.array(n0), pa.array((n1 > 0).astype(np.int32)), pa.array(mean - last, mask=~both), pa.array(both.astype(np.int32))]
            made |= dict(zip(family(n), values))
        out.append(made)
    return out


def with_families(df: DataFrame, key: str, day: str, bases: list[str], windows: tuple[int, ...], columns: list[str]) -> DataFrame:
    """``columns``, in this order: those of ``df`` and <base>_<part>_<n>D of the bases. ``day``: a whole number."""
    sources = list(dict.fromkeys([key, day, *bases, *[c for c in columns if c in df.columns]]))
    kinds = {b: F.col(b).cast(_KIND).alias(b) for b in bases}
    rows = df.select(*[kinds.get(c, F.col(c)) for c in sources]).repartition(key).sortWithinPartitions(key, day)
    made = {f"{b}_{part}": (b, part) for b in bases for n in windows for part in family(n)}
    types = {"COUNT": T.LongType(), "PREV_COUNT": T.LongType(), "MEAN_VALID": T.IntegerType(), "MEAN_SHIFT_VALID": T.IntegerType()}
    plain = {f.name: f for f in rows.schema.fields}

    def kind(c: str) -> T.StructField:
        if c in plain:
            return plain[c]
        return T.StructField(c, types.get(made[c][1].rsplit("_", 1)[0], T.DoubleType()))

    ahead = 2 * max(windows)

    def work(held: pa.Table, new: int, last: bool):
        """Rows that are complete, and those that later ones need; ``new``: where rows begin that are not given yet."""
        t = held.combine_chunks()
        codes = t.column(key).combine_chunks().dictionary_encode() if t.num_rows else None
        if codes is None:
            return None, held, 0
        codes = codes.indices.to_numpy(zero_copy_only=False) if not codes.null_count else codes.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        segment = np.concatenate([[0], np.cumsum(codes[1:] != codes[:-1])]).astype(np.int64)
        days = t.column(day).combine_chunks().cast(pa.int64()).fill_null(_NO_DAY).to_numpy(zero_copy_only=False)
        open_ = (segment == segment[-1]) & (days == days[-1])  # peers may follow
        keep = np.flatnonzero((np.arange(t.num_rows) >= new) & (last | ~open_))
        out = None
        if len(keep):
            found = dict(zip(bases, _features([t.column(b).combine_chunks() for b in bases], segment, days, windows, keep)))
            part = t.take(pa.array(keep))
            out = pa.RecordBatch.from_arrays([part.column(c).combine_chunks() if c in plain else found[made[c][0]][made[c][1]] for c in columns], columns)
        rest = np.flatnonzero(open_ | ((segment == segment[-1]) & (days >= days[-1] - ahead)))
        return out, t.take(pa.array(rest)), int((~open_[rest]).sum())

    def run(batches):
        held, new, waiting = None, 0, []
        for b in batches:
            waiting.append(b)
            if sum(x.num_rows for x in waiting) < ROWS:
                continue
            t = pa.Table.from_batches(waiting)
            out, held, new = work(t if held is None else pa.concat_tables([held, t]), new, False)
            waiting = []
            if out is not None:
                yield out
        if waiting or held is not None:
            t = pa.Table.from_batches(waiting) if waiting else held.slice(0, 0)
            out, _, _ = work(t if held is None else pa.concat_tables([held, t]), new, True)
            if out is not None:
                yield out

    return rows.mapInArrow(run, T.StructType([kind(c) for c in columns]))
