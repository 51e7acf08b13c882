"""Running sums, places and quantiles in a global order without one task for all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnforge.functions.lineage import cut


def running_sums(df: DataFrame, by: str, sums: dict[str, str], descending: bool = False) -> DataFrame:
    """Adds, for each {name: column}, the sum of the column over all rows up to and with this one in the
    order of ``by`` (values distinct), and ``<name>_all``, the sum over all rows.

    Rows are dealt out by ranges of ``by`` and kept so; each range adds the totals of those before it.
    """
    order = F.col(by).desc() if descending else F.col(by).asc()
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df = cut(df.repartitionByRange(parts, order)).withColumn("_part", F.spark_partition_id())
    totals = df.groupBy("_part").agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])  # one row a partition
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = totals.select("_part", *[e for n in sums for e in (F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_a_{n}"), F.sum(f"_t_{n}").over(Window.partitionBy()).alias(f"{n}_all"))])
    own = Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumns({f"_o_{n}": F.sum(c).over(own) for n, c in sums.items()}).join(F.broadcast(ahead), "_part")
    out = out.withColumns({n: F.col(f"_o_{n}") + F.col(f"_a_{n}") for n in sums})
    return out.drop("_part", *[f"_o_{n}" for n in sums], *[f"_a_{n}" for n in sums])


def ordered(df: DataFrame, order: list[Column], place: str = "place", lags: dict[str, tuple[str, int]] | None = None, leads: dict[str, tuple[str, int]] | None = None) -> DataFrame:
    """Adds each row's place in a global order, and under each name of ``lags`` (``leads``) a column's value so many rows
    before (behind), null beyond the ends. No task sees all rows.

    Rows are dealt out by ranges of the order. A value that lies in an earlier or later range is among the first or last rows of its
    range; these, as many as the largest offset a range, are handed to all by their places.
    """
    lags, leads = lags or {}, leads or {}
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cols = df.columns
    df = cut(df.repartitionByRange(parts, *order)).withColumn("_part", F.spark_partition_id())
    sizes = df.groupBy("_part").agg(F.count("*").alias("_n"))  # one row a range
    ahead = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = Window.partitionBy("_part").orderBy(*order)
    near = {n: F.lag(c, k).over(own) for n, (c, k) in lags.items()} | {n: F.lead(c, k).over(own) for n, (c, k) in leads.items()}
    df = df.withColumns({"_i": F.row_number().over(own), **near}).join(F.broadcast(sizes.select("_part", "_n", ahead.alias("_ahead"))), "_part")
    df = df.withColumn(place, F.col("_i") + F.col("_ahead"))
    reach = max([k for _, k in [*lags.values(), *leads.values()]], default=0)
    if reach:
        df = cut(df)
        wanted = sorted({c for c, _ in [*lags.values(), *leads.values()]})
        edge = df.where((F.col("_i") <= reach) | (F.col("_i") > F.col("_n") - reach)).select(F.col(place).alias("_edge_place"), F.struct(*wanted).alias("_edge"))
        for sign, names in ((-1, lags), (1, leads)):
            for k in sorted({k for _, k in names.values()}):
                beyond = F.col("_i") <= k if sign < 0 else F.col("_i") > F.col("_n") - k
                df = df.join(F.broadcast(edge), F.when(beyond, F.col(place) + sign * k) == F.col("_edge_place"), "left")
                df = df.withColumns({n: F.when(beyond, F.col("_edge")[c]).otherwise(F.col(n)) for n, (c, j) in names.items() if j == k}).drop("_edge_place", "_edge")
    return df.select(*cols, *lags, *leads, place)


#: Rows of one for each group that are broadcast at most.
FEW = 1 << 16


def few(df: DataFrame) -> DataFrame:
    """Rows cut off their lineage, marked for a broadcast if they are at most FEW: a join of all rows with a few groups by
    their keys would sort each group in one task."""
    df = cut(df)
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df


def _between(a: Column, b: Column, part: Column) -> Column:
    """a * (1 - part) + b * part as ``quantile_cont`` takes it, the first product and the sum rounded once: the product's rounding
    error is found by halves of its factors and added to that of the sum."""
    w, e = 1 - part, b * part
    p = a * w
    high = lambda v: v * 134217729.0 - (v * 134217729.0 - v)
    ah, wh = high(a), high(w)
    lost = ((ah * wh - p) + ah * (w - wh) + (a - ah) * wh) + (a - ah) * (w - wh)
    total = p + e
    kept = total - p
    exact = total + (((p - (total - kept)) + (e - kept)) + lost)
    return F.when(F.greatest(F.abs(a), F.abs(b)) < 1e290, exact).otherwise(total)


def quantiles(df: DataFrame, col: str | Column, fractions: list[float], by: list[str] | None = None, name: str = "_q", accuracy: int = 10_000) -> DataFrame:
    """Exact interpolated quantiles of a column: ``by`` and ``name``, an array in the order of ``fractions``. As with ``percentile`` nulls don't count,
    a group without values has null, and without ``by`` there is one row.

    Approximate quantiles, of bounded memory, give each fraction a bracket of some ten-thousandths of the rows. Rows below the bracket are counted, and
    only the counts of the values inside are put in order. A bracket that the counts show to miss its places is widened to all values.
    """
    by, k = by or [], len(fractions)
    keys = [f"_by{i}" for i in range(len(by))]
    rows = df.select(*[F.col(c).alias(b) for c, b in zip(by, keys, strict=True)], (F.col(col) if isinstance(col, str) else col).cast("double").alias("_x"))
    near = [min(max(f + d, 0.0), 1.0) for d in (-4 / accuracy, 4 / accuracy) for f in fractions]
    bounds = cut(rows.groupBy(*keys).agg(F.count("_x").alias("_n"), F.min("_x").alias("_least"), F.max("_x").alias("_most"), F.percentile_approx("_x", F.array(*map(F.lit, near)), accuracy).alias("_near")))
    broad = F.broadcast if not by or bounds.limit(FEW + 1).count() <= FEW else lambda d: d
    place = [(F.col("_n") - 1) * F.lit(float(f)) for f in fractions]

    def beside(left: DataFrame, right: DataFrame) -> DataFrame:
        right = broad(right.withColumnsRenamed({b: f"{b}r" for b in keys}))
        if not by:
            return left.crossJoin(right)  # one row
        same = F.lit(True)
        for b in keys:
            same = same & F.col(b).eqNullSafe(F.col(f"{b}r"))
        return left.join(right, same).drop(*[f"{b}r" for b in keys])

    x, low, high = F.col("_x"), [F.col("_near")[i] for i in range(k)], [F.col("_near")[k + i] for i in range(k)]
    held = beside(rows.where(x.isNotNull()), bounds.select(*keys, "_near"))
    held = held.groupBy(*keys).agg(*[e for i in range(k) for e in (F.count_if(x < low[i]).alias(f"_below{i}"), F.count_if(x <= high[i]).alias(f"_upto{i}"))])
    marks = []
    for i, p in enumerate(place):
        hit = (F.col(f"_below{i}") <= F.floor(p)) & (F.col(f"_upto{i}") > F.ceil(p))
        marks.append(F.struct(F.lit(i).alias("i"), F.when(hit, low[i]).otherwise(F.col("_least")).alias("low"), F.when(hit, high[i]).otherwise(F.col("_most")).alias("high"), F.when(hit, F.col(f"_below{i}")).otherwise(0).alias("below"), p.alias("place")))
    marks = beside(bounds, held).select(*keys, F.array(*marks).alias("_marks"))
    inside = beside(rows.where(x.isNotNull()), marks).select(*keys, "_x", F.explode(F.filter("_marks", lambda m: (x >= m["low"]) & (x <= m["high"]))).alias("_m"))
    inside = inside.groupBy(*keys, "_m", "_x").agg(F.count("*").alias("_k"))
    upto = F.sum("_k").over(Window.partitionBy(*keys, "_m").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)) + F.col("_m.below")
    one = inside.withColumn("_upto", upto).groupBy(*keys, "_m").agg(F.min(F.when(F.col("_upto") > F.floor("_m.place"), x)).alias("a"), F.min(F.when(F.col("_upto") > F.ceil("_m.place"), x)).alias("b"))
    part = F.col("_m.place") - F.floor("_m.place")
    one = one.withColumn("part", part)
    value = F.when((F.col("a") == F.col("b")) | (F.col("part") == 0), F.col("a")).otherwise(_between(F.col("a"), F.col("b"), F.col("part")))
    found = one.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_m.i", value.alias("v")))).alias("_v")).select(*keys, F.when(F.size("_v") > 0, F.col("_v.v")).alias(name))
    if not by:
        return found
    empty = bounds.where("_n = 0").select(*keys, F.lit(None).cast("array<double>").alias(name))
    return found.unionByName(empty).withColumnsRenamed(dict(zip(keys, by, strict=True)))
