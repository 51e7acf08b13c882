"""Near copies by similarity: SimHash near-dedup (``golay_dedup``) widened to a Jaccard similarity of
five-word shingle sets. The pipeline's near-dedup.

Two texts link where at least ``SHARE`` of all their different shingles are in both. Candidates come
from two sources and are all verified by their whole sets:

1. The Golay keys of ``golay_dedup`` on 64-bit SimHashes of the five-word shingles. They meet all
   pairs of three or fewer differing bits, which are those of nearly all shingles in common.
2. ``BANDS`` fingerprints of ``ROWS`` minimum hashes each, for what lies beyond: at a similarity of
   0.8 SimHashes differ in ten bits of 64, more than any choice of Golay keys of that length meets
   (see the README), while a pair shares one of these but in 1 of 38,000 cases.

Texts of the same set are one node. A bucket (of one SimHash or one band) first compares its members
with ``PIVOTS`` of them only, so that a group of near copies costs its size and not the square of it.
What is then in one component needs no more; in buckets of several components all pairs of
different ones are compared. The components are those of all linked candidates.

Pairs are compared inside the joins by the parities of ``WIDTH`` classes of hashes first: every
parity that differs takes a shingle of one set only, so too many rule a pair out, and no linked
pair is lost. Only what passes is made as a row. Whole sets are made and moved of texts in such
pairs alone: the texts are found by their hashes, which are broadcast up to ``FEW`` and else joined.
No other join broadcasts a side, so the driver holds nothing that grows with the documents.

Defined cases: a null or wordless text has the empty set, equal to itself only; a text of one
to four words has one shingle, the whole sequence; words and case are those of ``golay_dedup``; very
long texts count whole; repeated rows are one node; an empty table gives no rows; columns of any
name stay as they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnforge.llm import golay_dedup
from tarnforge.llm.common import apart, cut, small_batches
from tarnforge.llm.golay_dedup import SEED, components, keep_first, shingle_hashes, simhash

SHINGLE, BANDS, ROWS, PIVOTS = 5, 20, 4, 2
#: As a fraction, so that the comparison is of whole numbers.
SHARE = 4, 5
WIDTH = 512
#: Text hashes that are broadcast at most, of 8 bytes each.
FEW = 1 << 20
_STEP = 1 << 10
_RNG = np.random.default_rng(SEED)
_MUL = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def shingle_set(text: str | None) -> np.ndarray:
    """Different shingle hashes, sorted."""
    return np.unique(shingle_hashes(text, SHINGLE))


def band_keys(grams: np.ndarray) -> list[int]:
    """One signed key for each band; none of an empty set."""
    import xxhash

    if not len(grams):
        return []
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for k in range(0, len(grams), _STEP):
        low = np.minimum(low, (grams[k : k + _STEP, None] * _MUL + _ADD).min(axis=0))
    raw = low.astype("<u8").tobytes()
    keys = [xxhash.xxh64_intdigest(raw[8 * ROWS * i : 8 * ROWS * (i + 1)], i) for i in range(BANDS)]
    return np.array(keys, dtype=np.uint64).view(np.int64).tolist()


def node_of(grams: np.ndarray) -> int:
    import xxhash

    return int(np.array(xxhash.xxh64_intdigest(grams.astype("<u8").tobytes(), SEED), dtype=np.uint64).view(np.int64))


def parities(grams: np.ndarray) -> list[int]:
    """Parities of the counts of hashes in WIDTH classes, 64 to a number."""
    odd = np.bincount((grams % np.uint64(WIDTH)).astype(np.int64), minlength=WIDTH) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view("<i8").tolist()


_MARKS = [("fp", "long"), ("sim", "long"), ("bands", "array<long>"), ("n", "int"), ("odd", "array<long>")]


def marks(docs: DataFrame) -> DataFrame:
    """Columns and text to the columns, fp (the set's hash), sim (its SimHash), bands, n (the set's size), odd (its parities)."""
    small_batches(docs.sparkSession)
    rest = [c for c in docs.columns if c != "text"]

    def run(batches):
        for b in batches:
            sets = [shingle_set(x.as_py()) for x in b.column(0)]
            sim = np.array([simhash(g) for g in sets], dtype=np.uint64).view(np.int64)
            new = [
                pa.array([node_of(g) for g in sets], pa.int64()), pa.array(sim), pa.array([band_keys(g) for g in sets], pa.list_(pa.int64())),
                pa.array([len(g) for g in sets], pa.int32()), pa.array([parities(g) for g in sets], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], *new], names)

    names = [*rest, *[c for c, _ in _MARKS]]
    rows = docs.select("text", *rest)
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[1:], *T.StructType.fromDDL(", ".join(f"{c} {t}" for c, t in _MARKS)).fields]))


def sets(docs: DataFrame) -> DataFrame:
    """fp and grams, the whole set, of each document."""
    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            for x in b.column(0):
                g = shingle_set(x.as_py())
                yield pa.RecordBatch.from_arrays([pa.array([node_of(g)], pa.int64()), pa.array([g.view(np.int64)], pa.list_(pa.int64()))], ["fp", "grams"])

    return docs.select("text").mapInArrow(run, "fp long, grams array<long>")


def possible(na: str, a: str, nb: str, b: str) -> F.Column:
    """False only of pairs whose parities differ more than ``SHARE`` leaves room for."""
    apart = sum((F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in range(WIDTH // 64)), F.lit(0))
    return apart * sum(SHARE) <= (F.col(na) + F.col(nb)) * (SHARE[1] - SHARE[0])


def ordered(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Different pairs (a, b), a < b."""
    return pairs.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) of nodes that are as similar as ``SHARE``, by their whole sets."""
    pairs = cut(pairs)
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct()
    texts = cut(nodes.join(apart(wanted), "fp").select("fp", F.col("hash").alias("_hash")))
    few = texts.count() <= FEW
    chosen = docs.select("text", F.xxhash64("text").alias("_hash")).join(F.broadcast(texts.select("_hash")) if few else apart(texts.select("_hash")), "_hash", "left_semi")
    grams = cut(sets(chosen).join(apart(texts.select("fp")), "fp", "left_semi").groupBy("fp").agg(F.any_value("grams").alias("grams")))
    both = F.size(F.array_intersect("x", "y"))
    near = both * sum(SHARE) >= (F.size("x") + F.size("y")) * SHARE[0]  # both / (x + y - both) >= SHARE
    one, two = grams.select(F.col("fp").alias("a"), F.col("grams").alias("x")), grams.select(F.col("fp").alias("b"), F.col("grams").alias("y"))
    return cut(pairs.join(apart(one), "a").join(apart(two), "b").where(near).select("a", "b"))


def fingerprint_pairs(nodes: DataFrame) -> DataFrame:
    """Candidates by the Golay keys: one node of each SimHash against the others of it, and against one of each linked SimHash."""
    one = nodes.groupBy(F.col("sim").alias("fp")).agg(F.min("fp").alias("node"))
    same = nodes.join(apart(one.select(F.col("fp").alias("sim"), "node")), "sim").where("fp <> node").select(F.col("fp").alias("a"), F.col("node").alias("b"))
    near = golay_dedup.links(one)
    for c, name in (("a", "x"), ("b", "y")):
        near = near.join(apart(one.select(F.col("fp").alias(c), F.col("node").alias(name))), c)
    return same.unionByName(near.select(F.col("x").alias("a"), F.col("y").alias("b")))


def links(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Verified pairs (a, b) of nodes that have the components of all of them. ``nodes``: fp, hash (of a text), sim, bands, n, odd."""
    keyed = nodes.select("fp", F.explode("bands").alias("key"))
    pivots = F.array_distinct(F.array(*[F.min_by("fp", F.xxhash64("fp", *([] if i == 0 else ["key", F.lit(i)]))) for i in range(PIVOTS)]))
    shared = keyed.groupBy("key").agg(pivots.alias("pivots"), F.min("fp").alias("least"), F.max("fp").alias("most")).where("least < most")
    members = cut(keyed.join(apart(shared.select("key", "pivots")), "key").join(apart(nodes.select("fp", "n", "odd")), "fp"))
    chosen = members.where(F.array_contains("pivots", F.col("fp"))).select("key", F.col("fp").alias("pivot"), F.col("n").alias("pn"), F.col("odd").alias("podd"))
    star = members.drop("pivots").join(apart(chosen), "key").where("fp <> pivot").where(possible("n", "odd", "pn", "podd"))
    first = verified(ordered(star.select(F.col("fp").alias("a"), F.col("pivot").alias("b")).unionByName(fingerprint_pairs(nodes)), "a", "b"), docs, nodes)
    rooted = members.drop("pivots").join(apart(components(first).withColumnRenamed("node", "fp")), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    mixed = rooted.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least < most").select("key")
    left = cut(rooted.join(apart(mixed), "key", "left_semi"))
    one, two = (left.select("key", F.col("fp").alias(x), F.col("root").alias(f"r{x}"), F.col("n").alias(f"n{x}"), F.col("odd").alias(f"o{x}")) for x in "ab")
    rest = one.join(apart(two), "key").where("a < b and ra <> rb").where(possible("na", "oa", "nb", "ob"))
    return first.unionByName(verified(ordered(rest, "a", "b"), docs, nodes))


def near_copies(docs: DataFrame) -> DataFrame:
    """The columns beside text, fp, root (of the component)."""
    marked = cut(marks(docs.withColumn("hash", F.xxhash64("text"))))
    nodes = cut(marked.groupBy("fp").agg(*[F.any_value(c).alias(c) for c in ("hash", "sim", "bands", "n", "odd")]))
    found = components(links(docs, nodes)).withColumnRenamed("node", "fp")
    return marked.drop("hash", "sim", "bands", "n", "odd").join(apart(found), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """One document of each component stays, as in ``golay_dedup.deduplicate``."""
    return keep_first(docs, near_copies)
