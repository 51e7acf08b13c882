"""Sharding (native): rows in Hilbert-curve order of several metadata dimensions, cut in runs.

Each dimension is quantised to 2**bits cells at its quantiles, computed over all rows: approximate
ones of numbers, exact ones of whole strings, by the running counts of the distinct values in byte
order. The cells' place on a Hilbert curve is computed by a small state machine, whose
table follows from the Gray code, folded over the bit levels by a higher-order function.
Rows are sorted by place, with ties broken by columns of the caller's (the query: crc32 of the text,
size, id, so that copies of one cell are neighbours), and cut in runs whose row counts differ by at
most one. Near rows of all dimensions end up in the same
shard, so the min/max of each dimension in a shard prunes well.

No task sees more than its range partition: the global rank is the position inside the
partition plus the row counts of the partitions before it. A cell that holds a third of all
rows is split, since the sort continues with the tie-breakers. The sorted rows are
checkpointed, so that the counts and the positions are of the same partitions.

Defined cases: a null in any dimension is below all values; a null text has no bytes and
crc32 0; very long texts and values count whole; a dimension of one value is one cell; an empty
table gives no rows; repeated rows keep one place each; other columns are kept by
``hilbert_shards``, whose own names begin with an underscore, and ignored by the query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnforge.llm.common import cut, table
from tarnforge.operators.ranks import running_sums


def curve_tables(dims: int) -> tuple[list[int], list[int]]:
    """Digit and next state of a Hilbert curve, indexed by ``state * 2**dims + cell``.

    A state is an entry corner and a direction; cells are visited in Gray-code order seen
    from there.
    """
    n, size = dims, 1 << dims
    rot = lambda x, k: ((x >> k % n) | (x << (n - k % n))) & (size - 1)  # noqa: E731  to the right
    gray = [i ^ (i >> 1) for i in range(size)]
    rank = {g: i for i, g in enumerate(gray)}
    ones = lambda i: (~i & (i + 1)).bit_length() - 1  # noqa: E731  trailing set bits
    entry = [0] + [gray[2 * ((i - 1) // 2)] for i in range(1, size)]
    turn = [0] + [(ones(i - 1) if i % 2 == 0 else ones(i)) % n for i in range(1, size)]
    digit, after = [], []
    for state in range(n * size):
        e, d = state % size, state // size
        for cell in range(size):
            w = rank[rot(cell ^ e, d + 1)]
            digit.append(w)
            e2 = e ^ rot(entry[w], n - (d + 1) % n)
            after.append((d + turn[w] + 1) % n * size + e2)
    return digit, after


def hilbert_index(cells: list[Column], bits: int) -> Column:
    """Place on the curve of a point with ``bits``-bit coordinates."""
    digit, after = (F.array(*map(F.lit, t)) for t in curve_tables(len(cells)))
    size = 1 << len(cells)

    def step(acc: Column, level: Column) -> Column:
        corner = F.lit(0)
        for j, c in enumerate(cells):
            corner = corner + F.call_function("shiftright", c, level).bitwiseAND(F.lit(1)) * (1 << j)
        at = acc["state"] * size + corner + 1
        return F.struct(F.element_at(after, at).alias("state"), (acc["place"] * size + F.element_at(digit, at)).cast("long").alias("place"))

    start = F.struct(F.lit(0).alias("state"), F.lit(0).cast("long").alias("place"))
    return F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1)), start, step, lambda a: a["place"])


def string_bounds(df: DataFrame, col: str, size: int) -> list[str]:
    """The values at ranks ceil(i / size * n), i = 1 to size - 1, of the n values that are not null."""
    counted = df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("v")).agg(F.count("*").alias("n"))
    ranked = running_sums(counted, "v", {"upto": "n"})
    found = ranked.agg(*[F.min(F.when(F.col("upto") * size >= F.col("upto_all") * i, F.col("v"))).alias(f"b{i}") for i in range(1, size)]).first()
    return [b for b in found if b is not None]


def quantise(df: DataFrame, dims: dict[str, str], bits: int, accuracy: int = 10_000) -> list[Column]:
    """Cell of each dimension (of kind string or long): how many of the 2**bits - 1 quantiles are not above the value."""
    size = 1 << bits
    points = [i / size for i in range(1, size)]
    numbers = [c for c, kind in dims.items() if kind != "string"]
    cuts = df.agg(*[F.percentile_approx(F.col(c).cast("long"), points, accuracy).alias(f"q{i}") for i, c in enumerate(numbers)]).first() if numbers else []
    out = []
    for c, kind in dims.items():
        bounds = string_bounds(df, c, size) if kind == "string" else cuts[numbers.index(c)]
        x = F.col(c) if kind == "string" else F.col(c).cast("long")
        cell = sum((F.when(x >= F.lit(b), 1).otherwise(0) for b in sorted(set(bounds or []), key=lambda b: b.encode() if kind == "string" else b)), F.lit(0))
        out.append(F.coalesce(cell, F.lit(0)).cast("int"))
    return out


def hilbert_shards(df: DataFrame, dims: dict[str, str], ties: list[str], shards: int, bits: int = 5) -> DataFrame:
    """Adds curve_place, shard (0 to shards - 1) and slot (gapless from 0 in each shard)."""
    spark = df.sparkSession
    cells = quantise(df, dims, bits)
    names = [f"_cell{i}" for i in range(len(cells))]
    df = df.withColumns(dict(zip(names, cells)))
    df = df.withColumn("curve_place", hilbert_index([F.col(n) for n in names], bits)).drop(*names)
    keys = ["curve_place", *ties]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df = cut(df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)).withColumn("_at", F.monotonically_increasing_id())
    df = df.withColumn("_part", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    counts = df.groupBy("_part").agg(F.count("*").alias("_n"))  # as many rows as partitions
    ahead = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_ahead"), F.sum("_n").over(Window.partitionBy()).alias("_all"))
    df = df.join(F.broadcast(ahead), "_part").withColumn("_rank", F.col("_ahead") + F.col("_at"))
    df = df.withColumn("shard", F.floor(F.expr(f"_rank * {shards} DIV _all")).cast("int"))
    first = F.expr(f"(shard * _all + {shards - 1}) DIV {shards}")
    return df.withColumn("slot", (F.col("_rank") - first).cast("long")).drop("_part", "_at", "_ahead", "_all", "_rank")


def shard_manifest(sharded: DataFrame, dims: list[str]) -> DataFrame:
    """Rows, bytes and the range of each dimension by shard: what a reader prunes with."""
    ranges = [f(c).alias(f"{n}_{c}") for c in dims for n, f in (("min", F.min), ("max", F.max))]
    return sharded.groupBy("shard").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"), *ranges)


def op2_hilbert_shards(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "lang", "source", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"), F.coalesce(F.crc32("text"), F.lit(0).cast("long")).alias("text_crc32"),
    )
    docs = cut(docs)
    out = hilbert_shards(docs, {"lang": "string", "source": "string", "size": "long"}, ["text_crc32", "size", "doc_id"], 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve_place")


def op2_sql(shards: int = 24, bits: int = 5) -> str:
    """DuckDB SQL of op2, with exact quantiles: those that the approximate ones of sizes equal below 10,000 rows.
    The CRC is folded over half bytes, the curve over the bit levels."""
    half = []
    for x in range(16):
        for _ in range(4):
            x = (x >> 1) ^ (0xEDB88320 if x & 1 else 0)
        half.append(x)
    digit, after = curve_tables(3)
    size = 1 << bits
    cell = lambda c: f"(SELECT coalesce(sum(CASE WHEN {c} >= b THEN 1 ELSE 0 END), 0)::INTEGER FROM (SELECT DISTINCT unnest(list_transform(range(1, {size}), lambda i: q.{c}s[ceil(i / {size}.0 * len(q.{c}s))::BIGINT])) AS b))"
    levels = "s0 AS (SELECT *, 0 AS state, 0::BIGINT AS place FROM c)"
    for k in range(bits):
        v = bits - 1 - k
        corner = f"((a >> {v}) & 1) + 2 * ((b >> {v}) & 1) + 4 * ((e >> {v}) & 1)"
        levels += f", s{k + 1} AS (SELECT * REPLACE ({after}[state * 8 + {corner} + 1] AS state, place * 8 + {digit}[state * 8 + {corner} + 1] AS place) FROM s{k})"
    return f"""
WITH t AS (SELECT doc_id, lang, source, hex(encode(coalesce(text, ''))) AS h, (octet_length(encode(coalesce(text, ''))) + 8)::BIGINT AS size FROM documents),
d AS (SELECT doc_id, size, lang AS la, source AS so, size AS si,
  CASE WHEN h = '' THEN 0 ELSE xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(h) + 1), lambda i: ('0x' || h[CASE WHEN i % 2 = 1 THEN i + 1 ELSE i - 1 END])::BIGINT)),
    lambda x, y: xor(x >> 4, ({half}::BIGINT[])[((xor(x, y) & 15) + 1)::BIGINT])), 4294967295::BIGINT) END AS text_crc32 FROM t),
q AS (SELECT list(la ORDER BY la) FILTER (WHERE la IS NOT NULL) AS las, list(so ORDER BY so) FILTER (WHERE so IS NOT NULL) AS sos, list(si ORDER BY si) AS sis FROM d),
c AS (SELECT d.*, {cell('la')} AS a, {cell('so')} AS b, {cell('si')} AS e FROM d, q),
{levels},
r AS (SELECT *, row_number() OVER (ORDER BY place, text_crc32, size, doc_id NULLS FIRST) - 1 AS rank, count(*) OVER () AS n FROM s{bits})
SELECT doc_id, size, text_crc32::BIGINT AS text_crc32, 'rows' AS law, (rank * {shards} // n)::INTEGER AS shard, (rank - ((rank * {shards} // n) * n + {shards - 1}) // {shards})::BIGINT AS slot, NULL::INTEGER AS grown_shard, place AS curve_place FROM r
"""


OP2_SQL = op2_sql()
