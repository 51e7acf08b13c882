"""SimHash near-dedup with Golay-code fuzzy hashing.

Fingerprints link at ``RADIUS`` = 3 or fewer differing bits. A fingerprint has four segments of
16 bits; of three errors, some segment has none. The 48 bits beside it hold two words of 23
bits, of which one has at most one error. So two linked fingerprints agree exactly in one
segment and within one bit in one word: eight combinations. A word is keyed by the index of
its nearest Golay codeword on one side of the join, and on the other by all codewords within
distance 4; two words one bit apart then always share a key, since a word's nearest codeword
is at most 3 away. Keys have 3 + 16 + 12 bits, so few fingerprints share one by
chance. Every candidate is verified by its bits.

Equal fingerprints are one node, however many documents have them, and a node has at most 43,744
others within three bits; so the links of a group of copies grow with its different
fingerprints, never with the square of its size. Candidates are verified inside the join, and
links are contracted to stars in rounds (each neighbourhood to its minimum), with every round
checkpointed. No join broadcasts a side: a fingerprint has some fifty keys, which Spark's estimate does not know.

Candidates by chance grow as the square of the different fingerprints: two that are unlike share a
key in 48 of 2**28 cases. That is a few a fingerprint at 10**8 of them, and too many beyond some
10**9; a larger corpus needs fingerprints of more bits and segments, not other joins.

Defined cases: a null or wordless text has fingerprint zero and links like any other; a text
of one or two words has one shingle, the whole sequence; very long texts count whole, some shingles
at a time; a null id is kept, and the component of null ids alone is null; repeated rows and ids
stay repeated, in one component; an empty table gives no rows; other columns, of any name, are
ignored by the query and kept by ``deduplicate``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnforge.llm.common import apart, cut, free_name, small_batches, table
from tarnforge.llm.golay import Decoder

RADIUS, SHINGLE, SEED = 3, 3, 42
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_STEP = 1 << 13


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """Hashes of all word shingles, repeats included; none of a wordless text."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()  # at \x20 and \x09-\x0D
    if not words:
        return np.zeros(0, dtype=np.uint64)
    flat = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    n = max(1, len(words) - size + 1)
    begins = [0, *ends[: n - 1].tolist()]
    stops = (ends[min(size, len(words)) - 1 :] - 1).tolist()
    hashed = xxhash.xxh64_intdigest
    return np.fromiter((hashed(flat[a:b], SEED) for a, b in zip(begins, stops)), dtype=np.uint64, count=n)


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """64-bit SimHash of all word shingles, repeats included, as an unsigned number."""
    return simhash(shingle_hashes(text, size))


def simhash(h: np.ndarray) -> int:
    """Bit by bit the majority of the hashes."""
    n = len(h)
    if not n:
        return 0
    total = np.zeros(64, dtype=np.int64)
    for k in range(0, n, _STEP):
        part = h[k : k + _STEP].astype("<u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = SHINGLE, carry: list[str] | None = None) -> DataFrame:
    """``(doc_id, text)`` to doc_id, the columns in ``carry``, fp (as a signed long)."""
    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(x.as_py(), size) for x in b.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), *b.columns[2:], pa.array(fp)], names)

    names = ["doc_id", *(carry or []), "fp"]
    rows = docs.select("doc_id", "text", *(carry or []))
    return rows.mapInArrow(run, T.StructType([rows.schema.fields[0], *rows.schema.fields[2:], T.StructField("fp", T.LongType())]))


def keys_of(fp: np.ndarray, decoder: Decoder, wide: bool) -> tuple[np.ndarray, np.ndarray]:
    """Keys, and the row of ``fp`` each belongs to. ``wide``: of all near codewords, else of the nearest."""
    fp = fp.view(np.uint64)
    keys, rows = [], []
    for s in range(4):
        exact = ((fp >> np.uint64(16 * s)) & np.uint64(0xFFFF)).astype(np.int64)
        low = fp & np.uint64((1 << 16 * s) - 1)
        high = (fp >> np.uint64(16 * s + 16)) << np.uint64(16 * s) if s < 3 else np.zeros_like(fp)
        rest = low | high  # the other 48 bits
        for w in range(2):
            word = ((rest >> np.uint64(24 * w)) & np.uint64((1 << 23) - 1)).astype(np.int64)
            codes = decoder.indices(word)[:, : 6 if wide else 1]
            r, c = np.nonzero(codes >= 0)
            keys.append((((s * 2 + w) << 28) | (exact[r] << 12) | codes[r, c]))
            rows.append(r)
    return np.concatenate(keys), np.concatenate(rows)


def key_table(nodes: DataFrame, wide: bool) -> DataFrame:
    name = "b" if wide else "a"

    def run(batches):
        decoder = Decoder()
        for b in batches:
            fp = b.column(0).to_numpy()
            keys, rows = keys_of(fp, decoder, wide)
            for k in range(0, len(keys), 65536):
                yield pa.RecordBatch.from_arrays([pa.array(keys[k : k + 65536]), pa.array(fp[rows[k : k + 65536]])], ["key", name])

    return nodes.select("fp").mapInArrow(run, f"key long, {name} long")


def links(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of distinct fingerprints within RADIUS; a pair may come more than once."""
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS)
    return key_table(nodes, False).join(apart(key_table(nodes, True)), "key").where(near).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """``(a, b)`` to (node, root) with the smallest node of each component, by star contraction."""
    edges = cut(edges.where("a <> b").distinct())
    state = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == state or not now[0]:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
        state = tuple(now)
        # Large star: neighbours above a node go to the smallest of its neighbourhood.
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(apart(least), "a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        # Small star: a node and its neighbours below go to the smallest of them.
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(apart(low), "a").select(F.col("m").alias("a"), "b").unionByName(low.select(F.col("m").alias("a"), F.col("a").alias("b")))
        edges = cut(small.where("a <> b").distinct(), rows=now[0])


def near_duplicates(docs: DataFrame, size: int = SHINGLE, carry: list[str] | None = None) -> DataFrame:
    """doc_id, ``carry``, fp, root (the component's smallest fingerprint), component_id: the smallest
    doc_id reachable over links."""
    marked = cut(fingerprints(docs, size, carry))
    nodes = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = components(links(nodes))
    # Both sides of the join by root have exchanges of their own, so that a hot component is split.
    rooted = cut(nodes.join(apart(found.withColumnRenamed("node", "fp")), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    least = cut(rooted.groupBy("root").agg(F.min("least").alias("component_id")))
    named = cut(rooted.join(apart(least), "root").select("fp", "root", "component_id"))
    return marked.join(apart(named), "fp").select("doc_id", *(carry or []), "fp", "root", "component_id")


def keep_first(docs: DataFrame, find) -> DataFrame:
    """One document of each component stays: the one of the smallest doc_id, with all columns.

    ``find`` takes doc_id, text, and two columns more, and gives these without text, and root. The one
    that stays is matched by id and text hash, so that an id that two texts share keeps
    or drops neither by the other's verdict; of repeated rows one stays; a null id is the largest.
    """
    mark, key = free_name(docs.columns, "_text"), free_name(docs.columns, "_key")
    hashed = F.xxhash64(F.coalesce("text", F.lit("")), F.col("text").isNull())
    named = F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit(""))  # never null: joins and grouping share one exchange
    found = find(docs.select("doc_id", "text", hashed.alias(mark), named.alias(key)))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", F.col(key).alias("key"), F.col(mark).alias("mark")))
    stay = found.groupBy("root").agg(first.alias("s")).select(F.col("s.key").alias(key), F.col("s.mark").alias(mark))
    rows = docs.withColumns({mark: hashed, key: named})
    return rows.join(apart(stay), [key, mark], "left_semi").dropDuplicates([key, mark]).select(*docs.columns)


def deduplicate(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """One document of each component stays, see ``keep_first``."""
    return keep_first(docs, lambda d: near_duplicates(d, size, d.columns[2:]))


def op9_golay_dedup(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
