"""Profiling: one pass wherever one pass can do, then unpivot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnforge.functions.lineage import cut
from tarnforge.functions.scalar import percent, ratio
from tarnforge.operators.gram import gram
from tarnforge.operators.ranks import few, quantiles, running_sums


def _with_totals(df: DataFrame, totals: dict[str, str]) -> DataFrame:
    """Adds {name: sum of a column over all rows} of aggregated rows, from one row that is broadcast; no
    task sees all groups."""
    return df.crossJoin(F.broadcast(df.agg(*[F.sum(c).alias(n) for n, c in totals.items()])))


def _with_quantiles(agg: DataFrame, df: DataFrame, x: Column, fractions: list[float], by: list[str]) -> DataFrame:
    """Adds ``_q``, the exact quantiles of x in the rows of df, to aggregates by the same columns."""
    q = quantiles(df, x, fractions, by)
    if not by:
        return agg.crossJoin(F.broadcast(q))  # one row
    q = q.withColumnsRenamed({c: f"_of_{i}" for i, c in enumerate(by)})
    same = F.lit(True)
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{i}"))
    return agg.join(q, same).drop(*[f"_of_{i}" for i in range(len(by))])


def _ranked(df: DataFrame, name: str) -> DataFrame:
    """Of (pattern_json, row_count): rank under ``name``, most frequent first, ``observed``, how many there
    are, ``upto``, the rows up to this one, and ``total``, all rows. By range partitions."""
    order = F.struct((-F.col("row_count")).alias("n"), F.col("pattern_json").alias("p"))
    out = running_sums(df.withColumn("_order", order).withColumn("_one", F.lit(1).cast("long")), "_order", {"_rank": "_one", "upto": "row_count"})
    return out.select(*df.columns, F.col("_rank").cast("int").alias(name), F.col("_rank_all").alias("observed"), "upto", F.col("upto_all").alias("total"))


def _unpivot(df: DataFrame, ids: list[str], groups: dict[str, dict[str, str]], label: str) -> DataFrame:
    """``groups``: label to {output: column}. One row a label."""
    names = list(next(iter(groups.values())))
    parts = ", ".join(f"'{g}', " + ", ".join(f"`{cols[n]}`" for n in names) for g, cols in groups.items())
    return df.select(*ids, F.expr(f"stack({len(groups)}, {parts}) AS ({label}, {', '.join(names)})"))


def null_profile(df: DataFrame, by: list[str], cols: list[str]) -> DataFrame:
    """by, column_name, row_count, null_count, null_rate."""
    g = df.groupBy(*by).agg(F.count("*").alias("_n"), *[F.count_if(F.col(c).isNull()).alias(f"_{c}") for c in cols])
    u = _unpivot(g, by, {c: {"row_count": "_n", "null_count": f"_{c}"} for c in cols}, "column_name")
    return u.withColumn("null_rate", F.round(ratio(F.col("null_count"), F.col("row_count")), 6))


def null_correlations(df: DataFrame, by: list[str], cols: list[str]) -> DataFrame:
    """Pairs of columns: both null, either null, conditional rates and Jaccard; null on zero
    denominators. n(n-1)/2 conditional sums in one pass instead of flattening each row twice."""
    z = {c: F.col(c).isNull() for c in cols}
    pairs = [(a, b) for i, a in enumerate(sorted(cols)) for b in sorted(cols)[i + 1 :]]
    g = df.groupBy(*by).agg(*[F.count_if(z[c]).alias(f"_{c}") for c in cols], *[F.count_if(z[a] & z[b]).alias(f"_{a}|{b}") for a, b in pairs])
    groups = {f"{a}|{b}": {"left_nulls": f"_{a}", "right_nulls": f"_{b}", "both_nulls": f"_{a}|{b}"} for a, b in pairs}
    u = _unpivot(g, by, groups, "pair")
    return u.select(
        *by, F.substring_index("pair", "|", 1).alias("left_column"), F.substring_index("pair", "|", -1).alias("right_column"), "left_nulls", "right_nulls", "both_nulls",
        F.round(ratio(F.col("both_nulls"), F.col("left_nulls")), 6).alias("p_right_given_left"), F.round(ratio(F.col("both_nulls"), F.col("right_nulls")), 6).alias("p_left_given_right"),
        F.round(ratio(F.col("both_nulls"), F.col("left_nulls") + F.col("right_nulls") - F.col("both_nulls")), 6).alias("jaccard"),
    )


def null_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """Columns ranked by nulls."""
    g = df.agg(F.count("*").alias("_n"), *[F.count_if(F.col(c).isNull()).alias(f"_{c}") for c in cols])
    u = _unpivot(g, [], {c: {"null_count": f"_{c}", "_n": "_n"} for c in cols}, "column_name")
    return u.select("column_name", "null_count", percent(F.col("null_count"), F.col("_n")).alias("null_pct"), F.row_number().over(Window.orderBy(F.desc("null_count"), "column_name")).alias("null_rank"))


def pattern(cols: list[str]) -> Column:
    """JSON list of the null columns, in the order given."""
    return F.to_json(F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in cols])))


def null_patterns(df: DataFrame, cols: list[str], limit: int | None = None) -> DataFrame:
    """Exact patterns: id (SHA-256), JSON, null columns, rows, share, rank, and how many patterns
    there are in all, counted before the limit."""
    g = df.groupBy(pattern(cols).alias("pattern_json")).agg(F.count("*").alias("row_count"))
    out = _ranked(g, "pattern_rank").select(
        F.sha2("pattern_json", 256).alias("pattern_id"), "pattern_json", F.size(F.from_json("pattern_json", "array<string>")).alias("null_columns"), "row_count",
        percent(F.col("row_count"), F.col("total")).alias("row_pct"), F.col("observed").alias("observed_patterns"), "pattern_rank",
    )
    return out if limit is None else out.where(F.col("pattern_rank") <= limit)


def null_count_distribution(df: DataFrame, cols: list[str]) -> DataFrame:
    """By number of null columns: patterns, rows, share."""
    p = null_patterns(df, cols)
    g = p.groupBy("null_columns").agg(F.count("*").alias("patterns"), F.sum("row_count").alias("row_count"))
    return _with_totals(g, {"_all": "row_count"}).withColumn("row_pct", percent(F.col("row_count"), F.col("_all"))).drop("_all")


def patterns_by_group(df: DataFrame, group: str, cols: list[str], top: int | None = None) -> DataFrame:
    """Shares in the group and of the pattern, rank, and cumulative coverage of the group."""
    g = df.groupBy(group, pattern(cols).alias("pattern_json")).agg(F.count("*").alias("row_count"))
    order = Window.partitionBy(group).orderBy(F.desc("row_count"), "pattern_json")
    whole, across = F.sum("row_count").over(Window.partitionBy(group)), F.sum("row_count").over(Window.partitionBy("pattern_json"))
    out = g.select(
        group, "pattern_json", "row_count", percent(F.col("row_count"), whole).alias("group_pct"), percent(F.col("row_count"), across).alias("pattern_pct"),
        percent(F.sum("row_count").over(order.rowsBetween(Window.unboundedPreceding, 0)), whole).alias("cumulative_pct"), F.row_number().over(order).alias("pattern_rank"),
    )
    return out if top is None else out.where(F.col("pattern_rank") <= top)


def patterns_to_reach(df: DataFrame, cols: list[str], share: float = 90.0) -> DataFrame:
    """How many patterns, most frequent first, reach a share of the rows."""
    p = _ranked(df.groupBy(pattern(cols).alias("pattern_json")).agg(F.count("*").alias("row_count")), "pattern_rank")
    before = percent(F.col("upto"), F.col("total")) - percent(F.col("row_count"), F.col("total"))
    return p.agg(F.coalesce(F.count_if(before < share), F.lit(0)).alias("patterns_needed"), F.count("*").alias("patterns"))


def compare_patterns(a: DataFrame, b: DataFrame, cols: list[str], names: tuple[str, str]) -> DataFrame:
    """Rank and share of each pattern in two periods; null where it does not occur."""
    sides = [null_patterns(d, cols).select("pattern_json", F.col("pattern_rank").alias(f"rank_{n}"), F.col("row_pct").alias(f"pct_{n}")) for d, n in zip((a, b), names)]
    return sides[0].join(sides[1], "pattern_json", "full_outer")


def feature_availability(df: DataFrame, pairs: list[tuple[str, str]], group: str, value: str) -> DataFrame:
    """Of paired columns: nulls and values in a group, rows of equal missingness, values elsewhere, and
    whether the pair is absent in the group by structure. One wide aggregate."""
    own = F.col(group) == value
    aggs, groups = [], {}
    for a, b in pairs:
        exprs = {
            "left_null": own & F.col(a).isNull(), "left_present": own & F.col(a).isNotNull(), "right_null": own & F.col(b).isNull(), "right_present": own & F.col(b).isNotNull(),
            "same_missing": own & (F.col(a).isNull() == F.col(b).isNull()), "elsewhere": ~own & (F.col(a).isNotNull() | F.col(b).isNotNull()),
        }
        aggs += [F.count_if(e).alias(f"_{a}_{n}") for n, e in exprs.items()]
        groups[f"{a}/{b}"] = {n: f"_{a}_{n}" for n in exprs}
    u = _unpivot(df.agg(*aggs), [], groups, "pair")
    none = (F.col("left_present") == 0) & (F.col("right_present") == 0)
    return u.withColumn("availability", F.when(none & (F.col("elsewhere") > 0), "absent_in_group").when(none, "absent_everywhere").otherwise("available"))


def univariate(df: DataFrame, col: str, by: list[str] | None = None, exact: bool = True, accuracy: int = 10_000) -> DataFrame:
    """Counts, quartiles and moments of a column. Moments are of doubles, so that no decimal sum
    overflows. ``exact`` false takes approximate quartiles, in the same pass."""
    x, three = F.col(col).cast("double"), [0.25, 0.5, 0.75]
    out = df.groupBy(*(by or [])).agg(
        F.count("*").alias("total_rows"), F.count(x).alias("non_null"), F.count_if(x.isNull()).alias("nulls"), percent(F.count_if(x.isNull()), F.count("*")).alias("null_pct"),
        F.min(x).alias("minimum"), F.round(F.avg(x), 6).alias("mean"), F.max(x).alias("maximum"), F.round(F.stddev_samp(x), 6).alias("stddev"), F.round(F.var_samp(x), 4).alias("variance"),
        *([] if exact else [F.percentile_approx(x, F.array(*map(F.lit, three)), accuracy).alias("_q")]),  # one state for all quartiles
    )
    if exact:
        out = _with_quantiles(out, df, x, three, by or [])
    q = {n: F.get("_q", F.lit(i)).alias(n) for i, n in enumerate(("q1", "median", "q3"))}
    return out.select(*(by or []), "total_rows", "non_null", "nulls", "null_pct", "minimum", q["q1"], "mean", q["median"], q["q3"], "maximum", "stddev", "variance")


def histogram(df: DataFrame, col: str, bins: int = 40) -> DataFrame:
    """Equal-width bins with the maximum in the last one; one bin if all values are equal."""
    x = df.where(F.col(col).isNotNull()).select(F.col(col).cast("double").alias("x"))
    b = x.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    j = x.crossJoin(F.broadcast(b))  # one row
    k = F.when(F.col("lo") == F.col("hi"), F.lit(1).cast("long")).otherwise(F.least(F.lit(bins).cast("long"), F.width_bucket("x", "lo", "hi", F.lit(bins))))
    return j.groupBy(k.alias("bin")).agg(F.min("x").alias("bin_min"), F.max("x").alias("bin_max"), F.count("*").alias("row_count"))


def pair_interaction(df: DataFrame, a: str, b: str) -> DataFrame:
    """Covariance, correlation and regression of b on a over complete pairs."""
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    p = df.where(x.isNotNull() & y.isNotNull())
    r = p.agg(F.count("*").alias("pairs"), F.round(F.covar_samp(x, y), 4).alias("covariance"), F.round(F.corr(x, y), 6).alias("correlation"), F.round(F.regr_slope(y, x), 6).alias("slope"), F.round(F.regr_intercept(y, x), 4).alias("intercept"))
    return r.withColumn("direction", F.when(F.col("correlation") > 0, "positive").when(F.col("correlation") < 0, "negative").otherwise("none"))


def distribution(df: DataFrame, by: list[str], top: int | None = None) -> DataFrame:
    """Counts and share of all rows; also two-way. ``top`` is applied after the share."""
    g = _with_totals(df.groupBy(*by).agg(F.count("*").alias("row_count")), {"_all": "row_count"})
    g = g.withColumn("row_pct", percent(F.col("row_count"), F.col("_all"))).drop("_all")
    return g if top is None else g.orderBy(F.desc("row_count"), *by).limit(top)


def listed(df: DataFrame, key: str, value: str, least: int = 2) -> DataFrame:
    """Keys with several distinct values, and the values in order."""
    return df.groupBy(key).agg(F.count_distinct(value).alias("n_values"), F.array_join(F.sort_array(F.collect_set(F.col(value).cast("string"))), ", ").alias("value_list")).where(F.col("n_values") >= least)


def identity_conflicts(df: DataFrame, key: str, value: str) -> DataFrame:
    """How many ids have more than one value. Two levels of partial aggregation."""
    g = df.select(key, value).distinct().groupBy(key).agg(F.count(value).alias("n"))
    return g.agg(F.count("*").alias("ids"), F.count_if(F.col("n") > 1).alias("ids_in_conflict"), F.coalesce(F.max("n"), F.lit(0)).alias("most_values"))


def duplicate_summary(df: DataFrame, keys: list[str]) -> DataFrame:
    """Groups that repeat a key; zeros where none does."""
    g = df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    z = lambda c: F.coalesce(c, F.lit(0))
    return g.agg(F.count("*").alias("duplicate_groups"), z(F.sum("n")).alias("rows_in_groups"), z(F.sum(F.col("n") - 1)).alias("excess_rows"), z(F.max("n")).alias("largest_group"))


def payload_duplicates(df: DataFrame, keys: list[str], payload: list[str]) -> DataFrame:
    """Groups of equal keys whose payload is equal in all columns. Such keys collide by themselves, so no join finds them first
    (it sorted all rows in its tasks, and lost null keys)."""
    g = df.groupBy(*keys, *payload).agg(F.count("*").alias("copies")).where("copies > 1")
    return g.select(*keys, "copies", F.xxhash64(*payload).alias("fingerprint"))


def days_per_entity(df: DataFrame, key: str, day: str) -> DataFrame:
    """Histogram of distinct days by entity."""
    return df.groupBy(key).agg(F.count_distinct(day).alias("days")).groupBy("days").agg(F.count("*").alias("entities"))


def days_per_entity_summary(df: DataFrame, key: str, day: str) -> DataFrame:
    g = df.groupBy(key).agg(F.count_distinct(day).alias("d"))
    return g.agg(F.count("*").alias("entities"), F.min("d").alias("minimum"), F.percentile("d", 0.25).alias("q1"), F.percentile("d", 0.5).alias("median"), F.percentile("d", 0.75).alias("q3"), F.max("d").alias("maximum"), *[F.count_if(F.col("d") >= n).alias(f"at_least_{n}") for n in (7, 14, 21)])


def flag_overlap(df: DataFrame, key: str, flags: dict[str, Column]) -> DataFrame:
    """Entities that ever have each flag, all flags, none."""
    g = df.groupBy(key).agg(*[F.max(F.when(e, 1).otherwise(0)).alias(n) for n, e in flags.items()])
    s = sum((F.col(n) for n in flags), F.lit(0))
    return g.agg(F.count("*").alias("entities"), *[F.count_if(F.col(n) == 1).alias(f"with_{n}") for n in flags], F.count_if(s == len(flags)).alias("with_all"), F.count_if(s == 0).alias("with_none"))


def iqr_outliers(df: DataFrame, col: str, by: list[str], k: float = 1.5, exact: bool = True) -> DataFrame:
    """Bounds by group and rows outside."""
    x = F.col(col).cast("double")
    b = quantiles(df, x, [0.25, 0.75], by) if exact else df.groupBy(*by).agg(F.percentile_approx(x, F.array(F.lit(0.25), F.lit(0.75))).alias("_q"))
    b = b.select(*by, F.get("_q", F.lit(0)).alias("q1"), F.get("_q", F.lit(1)).alias("q3"))
    b = b.withColumn("low", F.round(F.col("q1") - k * (F.col("q3") - F.col("q1")), 6)).withColumn("high", F.round(F.col("q3") + k * (F.col("q3") - F.col("q1")), 6))
    return (df.join(few(b), by) if by else df.crossJoin(F.broadcast(b))).groupBy(*by, "q1", "q3", "low", "high").agg(F.count(x).alias("non_null"), F.count_if((x < F.col("low")) | (x > F.col("high"))).alias("outliers"))


def outlier_lift(df: DataFrame, col: str, target: str, z: float = 3.0) -> DataFrame:
    """Share of IQR and z-score outliers and how their target rate compares with the whole. Population
    deviation; no z-outliers where it is 0."""
    x, y = F.col(col).cast("double"), F.col(target).cast("double")
    b = _with_quantiles(df.agg(F.avg(x).alias("m"), F.stddev_pop(x).alias("s"), F.avg(y).alias("base")), df, x, [0.25, 0.75], [])
    j = df.crossJoin(F.broadcast(b))  # one row
    q1, q3 = F.col("_q")[0], F.col("_q")[1]
    iqr = (x < q1 - 1.5 * (q3 - q1)) | (x > q3 + 1.5 * (q3 - q1))
    far = F.when(F.col("s") > 0, F.abs(x - F.col("m")) / F.col("s") >= z).otherwise(F.lit(False))
    rows = [("iqr", iqr), ("zscore", far)]
    agg = j.groupBy("base").agg(F.count(x).alias("n"), *[e for n, o in rows for e in (F.count_if(o).alias(f"{n}_n"), F.avg(F.when(o, y)).alias(f"{n}_rate"))])
    u = _unpivot(agg, ["base", "n"], {n: {"outliers": f"{n}_n", "rate": f"{n}_rate"} for n, _ in rows}, "rule")
    return u.select("rule", "outliers", percent(F.col("outliers"), F.col("n")).alias("outlier_pct"), F.round(ratio(F.col("rate"), F.col("base")), 4).alias("lift"))


def descriptives(df: DataFrame, col: str) -> DataFrame:
    """Upper quantiles, zeros, skew, excess kurtosis (population) and distinct values."""
    x = F.col(col).cast("double")
    names = ("p50", "p90", "p99", "p999")
    out = df.agg(
        percent(F.count_if(x == 0), F.count(x)).alias("zero_pct"), F.round(F.skewness(x), 4).alias("skew"), F.round(F.kurtosis(x), 4).alias("kurtosis"), F.count_distinct(x).alias("n_unique"),
    )
    out = _with_quantiles(out, df, x, [0.5, 0.9, 0.99, 0.999], [])
    return out.select(*[F.get("_q", F.lit(i)).alias(n) for i, n in enumerate(names)], "zero_pct", "skew", "kurtosis", "n_unique")


def monthly_prevalence(df: DataFrame, date: str, key: str, positive: Column, event: Column) -> DataFrame:
    """By month: rows, positive rate, active entities and entities with an event per 1,000."""
    g = df.groupBy(F.trunc(F.col(date), "month").alias("month")).agg(F.count("*").alias("row_count"), F.round(F.avg(F.when(positive, 1.0).otherwise(0.0)), 6).alias("prevalence"), F.count_distinct(key).alias("entities"), F.count_distinct(F.when(event, F.col(key))).alias("event_entities"))
    return g.withColumn("events_per_1000", F.round(1000 * ratio(F.col("event_entities"), F.col("entities")), 4))


def average_ranks(counted: DataFrame) -> DataFrame:
    """``(column_name, value, k)``, k rows each, to column_name, value, rank (ties averaged) and rows of the column: one
    ranking of all columns.

    The counts of distinct (column, value) lie in one range order, in which a column's ranks are the running
    sum from its first value on. Raw rows are never sorted, and the exchanges don't grow with the columns.
    """
    n = counted.groupBy(F.struct("column_name", "value").alias("at")).agg(F.sum("k").alias("n"))
    summed = running_sums(n, "at", {"upto": "n"}).select("at.column_name", "at.value", "n", "upto")
    ahead = summed.groupBy("column_name").agg(F.min(F.col("upto") - F.col("n")).alias("ahead"), F.sum("n").alias("rows"))  # one row a column
    rank = F.col("upto") - F.col("ahead") - (F.col("n") - 1) / 2.0
    return summed.join(F.broadcast(ahead), "column_name").select("column_name", "value", rank.alias("rank"), "rows")


def _long(cols: list[str]) -> Column:
    """The columns of a row as rows of column_name and value."""
    return F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("value")) for c in cols]))


def rank_correlations(df: DataFrame, cols: list[str], target: str) -> DataFrame:
    """Pearson and Spearman of each column with a target.

    All columns are unpivoted once and counted by (column, value, target's value): the only exchange of rows,
    whatever the columns. Their ranks and the target's are joined to the counts, and the sums are taken
    about the ranks' known mean. A target of few values is broadcast, as a join by it would sort all counts of a value in one task.
    """
    d = df.select(*dict.fromkeys([*cols, target])).dropna()
    pairs = cut(d.select(F.col(target).cast("double").alias("t"), _long(list(dict.fromkeys([*cols, target])))).groupBy("column_name", "value", "t").agg(F.count("*").alias("k")))
    ranks = cut(average_ranks(pairs))
    own = few(ranks.where(F.col("column_name") == target).select(F.col("value").alias("t"), F.col("rank").alias("t_rank")))
    x, y = (F.col(c) - (F.col("rows") + 1) / 2.0 for c in ("rank", "t_rank"))
    s = pairs.join(ranks, ["column_name", "value"]).join(own, "t").groupBy("column_name").agg(*[F.sum(F.col("k") * e).alias(n) for n, e in (("xy", x * y), ("xx", x * x), ("yy", y * y))])
    rho = F.col("xy") / F.nullif(F.sqrt("xx") * F.sqrt("yy"), F.lit(0.0))
    g = d.agg(*[F.corr(F.col(c).cast("double"), F.col(target).cast("double")).alias(f"_p_{c}") for c in cols])
    u = _unpivot(g, [], {c: {"pearson": f"_p_{c}"} for c in cols}, "column_name")
    return u.join(s.select("column_name", rho.alias("spearman")), "column_name", "left").select("column_name", F.round("pearson", 6).alias("pearson"), F.round("spearman", 6).alias("spearman"))


def rank_matrix(df: DataFrame, cols: list[str], least: float = 0.0) -> DataFrame:
    """Spearman of each pair of columns, those of at least ``least`` in size.

    Rows are unpivoted, joined to the ranks of all columns and gathered again: two exchanges, whatever the columns. The sums of
    all pairs are one matrix a task.
    """
    d = cut(df.select(*cols).dropna().withColumn("_row", F.monotonically_increasing_id()))
    long = d.select("_row", _long(cols))
    ranks = cut(average_ranks(long.groupBy("column_name", "value").agg(F.count("*").alias("k"))))
    place = F.array_position(F.array(*[F.lit(c) for c in cols]), F.col("column_name"))
    ranked = long.join(ranks, ["column_name", "value"]).groupBy("_row").agg(F.sort_array(F.collect_list(F.struct(place.alias("k"), (F.col("rank") - (F.col("rows") + 1) / 2.0).alias("r")))).alias("v"))
    sums = cut(gram(ranked.select(F.col("v.r").alias("v")), "v"))  # as many rows as pairs of columns
    own = sums.where("i = j").select("i", F.sqrt("s").alias("size"))
    j = sums.where("i < j").join(F.broadcast(own), "i").join(F.broadcast(own.select(F.col("i").alias("j"), F.col("size").alias("other"))), "j")
    name = lambda c: F.get(F.array(*[F.lit(x) for x in cols]), F.col(c))
    rho = F.round(F.col("s") / F.nullif(F.col("size") * F.col("other"), F.lit(0.0)), 6)
    return j.select(name("i").alias("left_column"), name("j").alias("right_column"), rho.alias("spearman")).where(F.abs("spearman") >= least)


def quantile_lift(df: DataFrame, col: str, target: str, bins: int = 10) -> DataFrame:
    """Prevalence and lift in quantile bins; equal edges are merged, the lowest value belongs to the
    first bin. The edges are a bounded array."""
    x = F.col(col).cast("double")
    b = _with_quantiles(df.agg(F.avg(F.col(target).cast("double")).alias("base")), df, x, [i / bins for i in range(bins + 1)], []).select(F.array_distinct("_q").alias("edges"), "base")
    j = df.where(x.isNotNull()).crossJoin(F.broadcast(b))  # one row
    k = F.greatest(F.size(F.filter("edges", lambda e: e < x)), F.lit(1))
    g = j.groupBy(k.alias("bin"), "base").agg(F.count("*").alias("row_count"), F.min(x).alias("low"), F.max(x).alias("high"), F.avg(F.col(target).cast("double")).alias("p"))
    return g.select("bin", "row_count", "low", "high", F.round("p", 6).alias("prevalence"), F.round(ratio(F.col("p"), F.col("base")), 4).alias("lift"))


def value_lift(df: DataFrame, col: str, target: str) -> DataFrame:
    """Prevalence, row share and lift by value."""
    y = F.col(target).cast("double")
    g = _with_totals(df.groupBy(col).agg(F.count("*").alias("row_count"), F.avg(y).alias("p"), F.sum(y).alias("_sum"), F.count(y).alias("_n")), {"_all": "row_count", "_all_sum": "_sum", "_all_n": "_n"})
    base = F.col("_all_sum") / F.col("_all_n")
    return g.select(col, "row_count", F.round("p", 6).alias("prevalence"), percent(F.col("row_count"), F.col("_all")).alias("row_pct"), F.round(ratio(F.col("p"), base), 4).alias("lift"))


def crosstab(df: DataFrame, rows: str, cols: str, values: list) -> DataFrame:
    """Counts with row totals."""
    return df.groupBy(rows).agg(*[F.count_if(F.col(cols) == v).alias(f"n_{v}") for v in values], F.count("*").alias("total"))


def risk_by_pattern(df: DataFrame, pattern_col: Column, failed: Column, complete: Column) -> DataFrame:
    """Failure rate by null pattern against the baseline in percentage points, only over rows whose
    follow-up is complete."""
    g = df.where(complete).groupBy(pattern_col.alias("pattern")).agg(F.count("*").alias("row_count"), F.count_if(failed).alias("failures"))
    g = _with_totals(g, {"_all": "row_count", "_failed": "failures"})
    base = 100.0 * F.col("_failed") / F.col("_all")
    return g.withColumn("failure_pct", percent(F.col("failures"), F.col("row_count"))).withColumn("difference_pp", F.round(100.0 * F.col("failures") / F.col("row_count") - base, 4)).drop("_all", "_failed")


def missingness_risk(df: DataFrame, cols: list[str], failed: Column) -> DataFrame:
    """Failure rate where a column is null and where it is present."""
    aggs, groups = [], {}
    for c in cols:
        e = {"null_rows": F.count_if(F.col(c).isNull()), "null_failures": F.count_if(F.col(c).isNull() & failed), "present_rows": F.count(c), "present_failures": F.count_if(F.col(c).isNotNull() & failed)}
        aggs += [v.alias(f"_{c}_{n}") for n, v in e.items()]
        groups[c] = {n: f"_{c}_{n}" for n in e}
    u = _unpivot(df.agg(*aggs), [], groups, "column_name")
    u = u.withColumn("null_rate", percent(F.col("null_failures"), F.col("null_rows"))).withColumn("present_rate", percent(F.col("present_failures"), F.col("present_rows")))
    return u.withColumn("difference_pp", F.round(F.col("null_rate") - F.col("present_rate"), 4))


def scalar(df: DataFrame, exprs: dict[str, Column]) -> dict:
    """Many scalar aggregates in one pass; names upper-cased, null as 0."""
    row = df.agg(*[e.alias(n) for n, e in exprs.items()]).first()
    return {n.upper(): row[n] or 0 for n in exprs}


def grain_metrics(df: DataFrame, key: str, entity: str, date: str) -> DataFrame:
    """Rows, distinct keys, distinct (entity, date) and distinct entities. A null part is ignored."""
    return df.agg(F.count("*").alias("row_count"), F.count_distinct(key).alias("keys"), F.count_distinct(entity, date).alias("entity_days"), F.count_distinct(entity).alias("entities"))
