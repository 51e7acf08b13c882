"""Hard-negative mining by distributed radix selection.

An anchor's positives are its ``positives`` best other rows of its label; for each of them the
best ``negatives`` rows of other labels are kept whose score lies between two fractions of the
positive's. Scores are whole numbers: inner products of quantised vectors. Both selections run
alike, by windows of scores (one of all scores for an anchor, one for an anchor and positive):

1. Each chunk of rows counts, for each window, the rows in ``1 << DIGIT`` equal buckets of scores. It sends the
   buckets from the top until they hold as many rows as the window still asks for: lower ones of its
   rows can't be among the best. The counts are added up and the bucket of the kth row is found.
2. That bucket is counted again by the next digit, until it is one score wide: the cutoff.
3. Only rows above the cutoff are gathered, and of those at the cutoff, by chunk, as many of the smallest
   ids as are still asked for. They are ranked by score and id.

Rows lie packed in chunks and anchors in packets, both checkpointed; each round joins packets to
chunks by a number of the chunk, so that every chunk meets every packet of anchors in some task, and
computes the scores anew: nothing of the size of rows x anchors is ever stored. Neither side is
broadcast by this code. A hot label or vector makes no task longer, since chunks are dealt by number.

Defined cases: rows with a null id, label or vector or a null, infinite or NaN component take no
part; vectors are compared with those of the same length only (an empty one has the score 0 with others);
other rows are those of other ids, and rows that share an id each count, anchors too; equal scores go by id;
a score of 2**59 or more in size, which longs can't hold safely, is no score; anchors without positives have no rows; an empty table gives no
rows; other columns, of any name, are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnforge.llm.common import cut, table
from tarnforge.llm.packets import from_bytes, packed, to_bytes

DIGIT, SCALE, POSITIVES, NEGATIVES = 9, 256, 5, 10
#: A negative's score is at least 3/10 and at most 9/10 of the positive's.
LOW, HIGH = (3, 10), (9, 10)
ANCHORS, CHUNK_BYTES, _STEP = 1024, 16 << 20, 1 << 20
_NONE = np.iinfo(np.int64).min
#: Scores are smaller in size, so that longs hold them and the fractions' multiples.
LARGEST = 1 << 59
_KEY = ["packet", "slot", "w"]


def usable(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, label, v: components as whole numbers in doubles. Rows that take no part are left out."""
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("vector").cast("array<double>").alias("vector"))
    return rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & finite).select("vec_id", "label", F.transform("vector", lambda x: x * float(scale)).alias("v"))


def _pack(t: pa.Table):
    t = t.combine_chunks()
    v = t["v"].combine_chunks()
    values = np.floor(v.flatten().to_numpy(zero_copy_only=False))
    most = np.abs(values).max(initial=0)
    kind = np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.float64
    lists = pa.LargeListArray.from_arrays(np.concatenate([[0], np.cumsum(v.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64), pa.array(values.astype(kind)))
    return to_bytes(pa.table({"vec_id": t["vec_id"], "label": t["label"], "v": lists})), t.num_rows


class Vectors:
    """Rows of a chunk or packet, by the length of their vectors."""

    def __init__(self, body):
        t = from_bytes(body).combine_chunks()
        self.ids, self.labels = (t[c].to_numpy() for c in ("vec_id", "label"))
        v = t["v"].combine_chunks() if isinstance(t["v"], pa.ChunkedArray) else t["v"]
        length, flat = v.value_lengths().to_numpy(zero_copy_only=False), v.flatten().to_numpy(zero_copy_only=False)
        begin = np.cumsum(length) - length
        self.by_length = {}
        for n in np.unique(length).tolist():
            rows = np.flatnonzero(length == n)
            self.by_length[n] = rows, flat[begin[rows, None] + np.arange(n)].astype(np.float64)


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products as longs, exact; ``_NONE`` for those of ``LARGEST`` and more."""
    if a.shape[1] * np.abs(a).max(initial=0) * np.abs(b).max(initial=0) < 1 << 53:
        return (a @ b.T).astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    exact = whole(a) @ whole(b).T
    return np.where(abs(exact) < LARGEST, exact, _NONE).astype(np.int64)


def _windows(column, i: int) -> dict[int, list[dict]]:
    """The windows of a packet's anchors by slot."""
    out: dict[int, list[dict]] = {}
    for w in column[i].as_py() or []:
        out.setdefault(w["slot"], []).append(w)
    return out


def _meetings(batches, columns):
    """For each anchor of each pair of a packet and a chunk: packet, slot, anchor id, label test, ids and scores."""
    held: tuple = (None, None)
    for b in batches:
        at = {c: b.column(k) for k, c in enumerate(columns)}
        for i in range(b.num_rows):
            chunk = at["chunk"][i].as_py()
            if held[0] != chunk:
                held = chunk, Vectors(at["rows"][i].as_py())
            rows, anchors, windows = held[1], Vectors(at["body"][i].as_py()), _windows(at["windows"], i)
            for n, (slots, a) in anchors.by_length.items():
                if n not in rows.by_length:
                    continue
                where, v = rows.by_length[n]
                ids, labels = rows.ids[where], rows.labels[where]
                step = max(1, _STEP // len(where))
                for k in range(0, len(slots), step):
                    for slot, s in zip(slots[k : k + step].tolist(), scores(a[k : k + step], v)):
                        if slot in windows:
                            yield at["packet"][i].as_py(), slot, anchors.ids[slot], labels == anchors.labels[slot], ids, s, windows[slot]


def _fits(anchor, alike, ids, s, same: bool):
    """Rows of the anchor's label beside its own, or rows of other labels."""
    ok = (alike & (ids != anchor) if same else ~alike) & (s != _NONE)
    return ids[ok], s[ok]


def _flush(rows: list, names: list[str]):
    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in zip(*rows)], names)


def _counts(same: bool, columns):
    names = [*_KEY, "bucket", "n"]

    def run(batches):
        out, size = [], 0
        for packet, slot, anchor, alike, ids, s, windows in _meetings(batches, columns):
            ids, s = _fits(anchor, alike, ids, s, same)
            for w in windows:
                if not w["open"]:
                    continue
                inside = s[(s >= w["lo"]) & (s <= w["hi"])]
                if not len(inside):
                    continue
                n = np.bincount((w["hi"] - inside) >> w["shift"])
                some = np.flatnonzero(n)
                some = some[: np.searchsorted(np.cumsum(n[some]), w["need"]) + 1]
                out.append(([packet] * len(some), [slot] * len(some), [w["w"]] * len(some), some, n[some]))
                size += len(some)
            if size > 1 << 16:
                yield from _flush(out, names)
                out, size = [], 0
        if out:
            yield from _flush(out, names)

    return run


def _gathered(same: bool, columns):
    names = [*_KEY, "anchor_id", "id", "score"]

    def run(batches):
        out, size = [], 0
        for packet, slot, anchor, alike, ids, s, windows in _meetings(batches, columns):
            ids, s = _fits(anchor, alike, ids, s, same)
            for w in windows:
                above = np.flatnonzero((s > w["cutoff"]) & (s <= w["most"]))
                ties = np.flatnonzero(s == w["cutoff"]) if w["need"] else above[:0]
                got = np.concatenate([above, ties[np.argsort(ids[ties], kind="stable")[: w["need"]]]])
                if len(got):
                    out.append(([packet] * len(got), [slot] * len(got), [w["w"]] * len(got), [anchor] * len(got), ids[got], s[got]))
                    size += len(got)
            if size > 1 << 16:
                yield from _flush(out, names)
                out, size = [], 0
        if out:
            yield from _flush(out, names)

    return run


def _joined(chunks: DataFrame, anchors: DataFrame, state: DataFrame, keys: int) -> DataFrame:
    told = state.groupBy("packet").agg(F.collect_list(F.struct(*[c for c in state.columns if c != "packet"])).alias("windows"))
    asked = anchors.join(told, "packet").select("packet", "body", "windows", F.explode(F.sequence(F.lit(0), F.lit(keys - 1))).alias("r"))
    number = F.shiftright("packet", 33) + F.col("packet").bitwiseAND(F.lit((1 << 33) - 1))
    rows = chunks.select(F.pmod(number, F.lit(keys)).cast("int").alias("r"), F.col("packet").alias("chunk"), F.col("body").alias("rows"))
    return rows.join(asked, "r")


def _narrowed(frames):
    """The windows after a digit: narrowed to the bucket of the kth row; closed where that is one score wide, and where
    no bucket is the kth's, as the window has fewer rows, which all are taken."""
    for w in frames:
        found = w["bucket"].notna().to_numpy()
        last = found & (w["shift"] == 0).to_numpy()
        bucket, before, shift = (w[c].fillna(0).to_numpy().astype(np.int64) for c in ("bucket", "before", "shift"))
        top = np.where(found, w["hi"] - (bucket << shift), w["hi"])
        w["lo"] = np.where(found, np.maximum(w["lo"], top - (np.int64(1) << shift) + 1), w["lo"])
        w["hi"] = top
        w["need"] = np.where(found, w["need"] - before, np.where(w["open"], 0, w["need"])).astype("int32")
        w["cutoff"] = np.where(last, top, w["cutoff"])
        w["open"] = w["open"].to_numpy() & found & ~last
        w["shift"] = np.where(found, np.maximum(shift - DIGIT, 0), shift).astype("int32")
        yield w.drop(columns=["bucket", "before"])


def select_best(chunks: DataFrame, anchors: DataFrame, windows: DataFrame, k: int, same: bool, span: int, keys: int) -> DataFrame:
    """The best ``k`` rows of each window: packet, slot, w, anchor_id, id, score, rank.

    ``windows``: packet, slot, w, lo, hi; none holds more than ``span`` scores."""
    width = F.col("hi") - F.col("lo") + 1
    digits = F.ceil(F.log2(width.cast("double"))).cast("int")  # where the double rounds down there is one bucket more
    state = windows.where("lo <= hi").select(
        *_KEY, "lo", "hi", F.greatest(digits - F.lit(DIGIT), F.lit(0)).alias("shift"), F.lit(k).alias("need"), F.lit(True).alias("open"),
        (F.col("lo") - 1).alias("cutoff"), F.col("hi").alias("most"),
    )
    state = cut(state)
    for _ in range(max(1, math.ceil((span.bit_length() + 1) / DIGIT))):
        pairs = _joined(chunks, anchors, state, keys)
        counted = pairs.mapInArrow(_counts(same, pairs.columns), "packet long, slot long, w long, bucket long, n long").groupBy(*_KEY, "bucket").agg(F.sum("n").alias("n"))
        run = F.sum("n").over(Window.partitionBy(*_KEY).orderBy("bucket"))
        kth = counted.join(state.select(*_KEY, "need"), _KEY).withColumn("upto", run).where("upto >= need and upto - n < need").select(*_KEY, "bucket", (F.col("upto") - F.col("n")).alias("before"))
        state = cut(state.join(kth, _KEY, "left").mapInPandas(_narrowed, state.schema))
        if not state.where("open").limit(1).count():
            break
    pairs = _joined(chunks, anchors, state, keys)
    got = pairs.mapInArrow(_gathered(same, pairs.columns), "packet long, slot long, w long, anchor_id long, id long, score long")
    order = F.row_number().over(Window.partitionBy(*_KEY).orderBy(F.desc("score"), "id"))
    return got.withColumn("rank", order).where(F.col("rank") <= k)


def _floor(x: Column, part: tuple[int, int]) -> Column:
    """floor(part[0] * x / part[1]) of a whole x."""
    y = x * part[0]
    return F.call_function("div", y - F.pmod(y, F.lit(part[1])), F.lit(part[1]))


def mine(vectors: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: tuple[int, int] = LOW, high: tuple[int, int] = HIGH, scale: int = SCALE) -> DataFrame:
    """``(vec_id, label, vector)`` to anchor_id, positive_id, rank, negative_id, positive_score, negative_score.
    ``is_anchor``: a condition on vec_id and label."""
    spark = vectors.sparkSession
    rows = usable(vectors, scale)
    chosen = rows.where(is_anchor)
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + F.pow(F.floor(x), F.lit(2.0)))
    longest, count = rows.agg(F.max(norm), F.count(F.when(is_anchor, True))).first()
    most = min(int((longest or 0.0) * (1 + 1e-9)) + 1, LARGEST)  # no inner product is larger
    chunks = packed(rows, _pack, CHUNK_BYTES)
    anchors = packed(chosen.repartition(max(1, -(-count // ANCHORS))), _pack, CHUNK_BYTES)
    keys = max(1, min(chunks.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    every = anchors.select("packet", F.explode(F.sequence(F.lit(0), F.col("size") - 1)).alias("slot"), F.lit(0).cast("long").alias("w"), F.lit(-most).cast("long").alias("lo"), F.lit(most).cast("long").alias("hi"))
    best = cut(select_best(chunks, anchors, every, positives, True, 2 * most, keys).select("packet", "slot", F.col("rank").cast("long").alias("w"), "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))
    score = F.col("positive_score")
    windows = best.select(*_KEY, (-_floor(-score, low)).alias("lo"), _floor(score, high).alias("hi"))
    found = select_best(chunks, anchors, windows, negatives, False, 2 * most, keys).drop("anchor_id")
    return found.join(best, _KEY).select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op11_hard_negatives(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.select("vec_id", moved.alias("label"), F.col("embedding").alias("vector")), F.col("vec_id") % 100 == 0)


OP11_SQL = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS alike, b.vec_id AS id, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
), p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT alike AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) <= 10
"""
