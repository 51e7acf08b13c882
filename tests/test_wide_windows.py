"""The vectorised windows against plain sums of decimals."""

import decimal
import random
from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarnforge.operators import wide_windows, windows


def plain(rows, i, n, c, before):
    """Sum and count of a frame of row i: days, or the rows without one where row i has none."""
    key, day = rows[i][:2]
    low, high = (-(2 * n - 1), -n) if before else (-(n - 1), 0)
    own = [r[2 + c] for r in rows if r[0] == key and (r[1] is None if day is None else r[1] is not None and day + low <= r[1] <= day + high)]
    own = [x for x in own if x is not None]
    return sum(own, Decimal(0)), len(own)


@pytest.mark.parametrize("size", [8192, 40, 1])
def test_against_plain_sums(spark, monkeypatch, size):
    """Gaps, repeated and missing days and entities, values of all sizes and signs, and batches that cut entities."""
    monkeypatch.setattr(wide_windows, "ROWS", size)
    monkeypatch.setattr(decimal.getcontext(), "prec", 80)
    rng = random.Random(size)
    big = Decimal(10) ** 30
    value = lambda kind: rng.choice([None, Decimal(rng.randint(-5, 5)), (Decimal(rng.randint(-(10**9), 10**9)) / 1000), *([big + Decimal("0.000001"), -big, Decimal(2**64), -Decimal("0.000001")] if kind else [])])
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, *range(40)]), value(0), value(1)) for _ in range(200)]
    rows += [("hot", k // 3, Decimal(k), None) for k in range(150)]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "e string, day int, x decimal(38,6), y decimal(38,6), i int")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(min(size, 10000)))
    try:
        names = [f"{b}_{p}" for b in ("x", "y") for n in (3, 7) for p in wide_windows.family(n)]
        got = {r.i: r for r in wide_windows.with_families(df, "e", "day", ["x", "y"], (3, 7), ["i", "e", "x", *names]).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(got) == list(range(len(rows)))
    for i in range(len(rows)):
        assert (got[i].e, got[i].x) == (rows[i][0], rows[i][2])
        for c, b in enumerate("xy"):
            for n in (3, 7):
                (s1, n1), (s0, n0) = plain(rows, i, n, c, False), plain(rows, i, n, c, True)
                r = {p: got[i][f"{b}_{p}_{n}D"] for p in ("MEAN", "COUNT", "PREV_COUNT", "MEAN_VALID", "MEAN_SHIFT", "MEAN_SHIFT_VALID")}
                assert (r["COUNT"], r["PREV_COUNT"], r["MEAN_VALID"], r["MEAN_SHIFT_VALID"]) == (n1, n0, int(n1 > 0), int(n1 > 0 and n0 > 0))
                mean, last = (float(s / k) if k else None for s, k in ((s1, n1), (s0, n0)))
                assert r["MEAN"] is None if mean is None else abs(r["MEAN"] - mean) <= 1e-12 * abs(mean)
                assert r["MEAN_SHIFT"] is None if mean is None or last is None else abs(r["MEAN_SHIFT"] - (mean - last)) <= 1e-12 * (abs(mean) + abs(last))


def test_against_the_windows_of_spark(spark):
    df = spark.range(3000).select((F.col("id") % 37).cast("string").alias("e"), (F.col("id") / 37).cast("int").alias("day"), F.when(F.col("id") % 5 > 0, F.col("id") % 101).cast("decimal(38,6)").alias("x"))
    cols = [f"x_{p}_7D" for p in ("MEAN", "COUNT", "PREV_COUNT", "MEAN_VALID", "MEAN_SHIFT", "MEAN_SHIFT_VALID")]
    one = windows.with_shifts(windows.rolling(df, "e", "day", ["x"], (7,)), ["x"], (7,)).select("e", "day", *cols).collect()
    two = wide_windows.with_families(df, "e", "day", ["x"], (7,), ["e", "day", *cols]).collect()
    key = lambda r: (r.e, r.day)
    for a, b in zip(sorted(one, key=key), sorted(two, key=key)):
        assert all((x is None) == (y is None) and (x is None or abs(float(x) - float(y)) < 1e-9) for x, y in zip(a[1:], b[1:]))


def test_no_rows(spark):
    df = spark.createDataFrame([], "e string, day int, x decimal(38,6)")
    assert wide_windows.with_families(df, "e", "day", ["x"], (7,), ["e", "x_MEAN_7D", "x_COUNT_7D"]).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.integers(-(10**37), 10**37), st.integers(-10, 10)), min_size=1, max_size=30), st.data())
def test_sums_are_exact(values, data):
    """Any whole numbers of up to 37 digits, as the float nearest to their sum."""
    import numpy as np
    import pyarrow as pa

    with decimal.localcontext(prec=80):
        c = pa.array([None if v is None else Decimal(v).scaleb(-6) for v in values], pa.decimal128(38, 6))
    there, parts = wide_windows._parts(c)
    assert there.tolist() == [v is not None for v in values]
    a = data.draw(st.integers(0, len(values)))
    b = data.draw(st.integers(a, len(values)))
    got = wide_windows._sums(parts, [(np.array([a]), np.array([b]))])[0][0]
    want = float(sum(v or 0 for v in values[a:b]))
    assert abs(got - want) <= 4e-16 * abs(want)
