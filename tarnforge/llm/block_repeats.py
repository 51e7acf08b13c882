"""Substring dedup by fixed-block anchors: passages that also stand in an earlier document go.

A repeat is a run of ``WINDOW`` = 50 or more words that stands in two documents. Of any such run of
a reference document one whole block of ``BLOCK`` = 25 words, of those that begin at its words 0, 25,
50, ..., lies in the first 49 words. So the non-overlapping blocks of all documents are the index (one
entry for 25 words), and every rolling window of 25 words probes it:

1. Each packet of documents sends the hashes of its rolling windows, once each and with the mark of
   those that are blocks, to buckets of hashes. A hash that is a block somewhere and stands in two or
   more documents is a hit; the packet is told which of its windows are hits.
2. Hits are extended: the windows of 50 words with a hit in their first half are hashed by 128 bits
   (96 of them are sent) and the smallest doc_id of each is found in the same way. A window of which
   a smaller doc_id than the document's is found is removed, and neighbouring windows make up the
   maximal repeat. Comparing windows by the smallest id of their class, not document by document,
   keeps a passage of many documents linear: no pairs are made in a group.

Texts are packed once, compressed, in the checkpoint folder. What is shuffled is a few bytes a word,
in lists; the texts are moved once for each answer, by their packets' numbers, never by a key of theirs.

Defined cases: a null or wordless text has no words and keeps nothing of nothing; a document of
under 50 words is left whole; words and case stay as they are; long texts count whole; a null id is the
largest of all; rows of one id don't remove from each other, repeated rows stay repeated; of a
repeat within one document nothing is removed; an empty table gives no rows; other columns, of any
name, are ignored by ``find_repeats`` and kept by ``remove_repeats``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnforge.llm.common import cut, free_name, table
from tarnforge.llm.packets import answered, bits, bucket_bits, flags, from_bytes, grown, packed, shrunk, to_bytes

WINDOW, CACHE, SEED = 50, 1 << 18, 13
_LAST = np.iinfo(np.int64).max
#: Odd multipliers of the two rolling hashes.
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class _Words(dict):
    """64-bit values of words, kept while they are few."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        got = xxhash.xxh3_64_intdigest(word, SEED)
        if len(self) < CACHE:
            self[word] = got
        return got


_words = _Words()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _rolling(values: np.ndarray, n: int, m: np.uint64) -> np.ndarray:
    """Hashes of all windows of n values: differences of one running sum, brought to a common power."""
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(len(values) - 1, 0), m)]))
    back = np.uint64(pow(int(m), -1, 1 << 64))
    total = np.concatenate([[np.uint64(0)], np.cumsum(values * power, dtype=np.uint64)])
    down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(len(values) - n, 0), back)]))
    return _mix((total[n:] - total[:-n]) * down) if len(values) >= n else np.zeros(0, dtype=np.uint64)


class Packet:
    """Documents of one packet in the order of their ids, as one sequence of words."""

    def __init__(self, body, window: int):
        rows = from_bytes(body)
        ids = rows.column(0).to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
        self.ids = [ids[i] for i in order]
        texts = rows.column(1).to_pylist()
        self.words = [(texts[i] or "").encode("utf-8", "surrogatepass").split() for i in order]  # at \x20 and \x09-\x0D
        self.keep = [rows.column(2)[i].as_py() for i in order] if rows.num_columns > 2 else None
        self.n = np.array([len(w) for w in self.words], dtype=np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.n)])
        self.values = np.fromiter((_words[w] for text in self.words for w in text), dtype=np.uint64, count=int(self.n.sum()))
        self.doc = np.repeat(np.arange(len(ids)), self.n)
        self.place = np.arange(len(self.values)) - self.begin[self.doc]
        self.named = np.array([_LAST if i is None else i for i in self.ids], dtype=np.int64)
        self.window, self.block = window, window // 2

    def probes(self):
        """Different hashes of the rolling windows of a block's length, sorted, and of each window its
        place in the packet and its hash's number. Only documents that hold a repeat's length count."""
        size = self.n[self.doc]
        at = np.flatnonzero((self.place + self.block <= size) & (size >= self.window))
        hashed = _rolling(self.values, self.block, _M1)[at] if len(at) else np.zeros(0, dtype=np.uint64)
        keys, number = np.unique(hashed, return_inverse=True)
        return keys, at, number

    def candidates(self, hit: np.ndarray):
        """Windows with a hit in the first half: their places, and the classes of equal ones: number of
        each window, 64 and 32 bits of hash and the smallest document of each class."""
        seen = np.concatenate([[0], np.cumsum(hit)])
        at = np.flatnonzero(self.place + self.window <= self.n[self.doc])
        at = at[seen[at + self.block] > seen[at]]
        if not len(at):
            return at, at, np.zeros(0, np.uint64), np.zeros(0, np.uint32), at
        one = _rolling(self.values, self.window, _M1)[at]
        two = (_rolling(_mix(self.values), self.window, _M2)[at] >> np.uint64(32)).astype(np.uint32)
        order = np.lexsort((at, two, one))
        a, b = one[order], two[order]
        first = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        number = np.empty(len(at), dtype=np.int64)
        number[order] = np.cumsum(first) - 1
        return at, number, a[first], b[first], self.doc[at[order[first]]]

    def hits(self, told, keys: np.ndarray, at: np.ndarray, number: np.ndarray, width: int) -> np.ndarray:
        hit = np.zeros(len(self.values), dtype=bool)
        hit[at] = _joined(told, keys, width)[number]
        return hit


def _slices(keys: np.ndarray, width: int):
    """Buckets by the first ``width`` bits of sorted keys, with their slices."""
    top = (keys >> np.uint64(63 - width)) >> np.uint64(1)
    edges = np.flatnonzero(np.concatenate([[True], top[1:] != top[:-1]])) if len(keys) else []
    for a, b in zip(edges, [*edges[1:], len(keys)]):
        yield int(top[a]), int(a), int(b)


def _joined(told, keys: np.ndarray, width: int) -> np.ndarray:
    """The told flags of all buckets, in the order of the keys."""
    got = {r["bucket"]: r["body"] for r in told or []}
    parts = [flags(got[k], b - a) for k, a, b in _slices(keys, width)]
    return np.concatenate(parts) if parts else np.zeros(0, dtype=bool)


def _ask_blocks(window: int, width: int):
    def ask(row):
        p = Packet(row["body"], window)
        keys, at, number = p.probes()
        block = np.zeros(len(keys), dtype=bool)
        block[number[p.place[at] % p.block == 0]] = True
        low, high = np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=np.int64)
        high[number] = p.doc[at]  # the last of each stays
        low[number[::-1]] = p.doc[at][::-1]
        several = p.named[low] != p.named[high] if len(keys) else block
        short = ((keys << np.uint64(width)) >> np.uint64(32)).astype(np.uint32)
        for k, a, b in _slices(keys, width):
            yield k, np.int64(b - a).tobytes() + bits(block[a:b]) + bits(several[a:b]) + shrunk(short[a:b])

    return ask


def _answer_blocks(bodies: list[bytes]) -> list[bytes]:
    """Of each key: is it a block of any, and held by several documents?"""
    keys, block, several = [], [], []
    for raw in bodies:
        n = int(np.frombuffer(raw, np.int64, 1)[0])
        m = -(-n // 8)
        block.append(flags(raw[8 : 8 + m], n))
        several.append(flags(raw[8 + m : 8 + 2 * m], n))
        keys.append(grown(raw[8 + 2 * m :], np.uint32))
    size = np.cumsum([len(k) for k in keys])[:-1]
    every = np.concatenate(keys)
    order = np.argsort(every, kind="stable")
    key = every[order]
    first = np.concatenate([[True], key[1:] != key[:-1]])
    begin = np.flatnonzero(first)
    found = np.logical_or.reduceat(np.concatenate(block)[order], begin)
    shared = np.logical_or.reduceat(np.concatenate(several)[order], begin) | (np.diff(begin, append=len(key)) > 1)
    out = np.empty(len(key), dtype=bool)
    out[order] = (found & shared)[np.cumsum(first) - 1]
    return [bits(x) for x in np.split(out, size)]


def _ask_windows(window: int, width: int):
    def ask(row):
        p = Packet(row["body"], window)
        probes = p.probes()
        _, _, one, two, least = p.candidates(p.hits(row["blocks"], *probes, width))
        for k, a, b in _slices(one, width):
            yield k, np.int64(b - a).tobytes() + shrunk(one[a:b]) + two[a:b].tobytes() + p.named[least[a:b]].tobytes()

    return ask


def _answer_windows(bodies: list[bytes]) -> list[bytes]:
    """Of each window: does another packet hold it in a document of a smaller id?"""
    one, two, least = [], [], []
    for raw in bodies:
        n = int(np.frombuffer(raw, np.int64, 1)[0])
        one.append(grown(raw[8 : 8 + 8 * n], np.uint64))
        two.append(np.frombuffer(raw, np.uint32, n, 8 + 8 * n))
        least.append(np.frombuffer(raw, np.int64, n, 8 + 12 * n))
    size = np.cumsum([len(k) for k in one])[:-1]
    a, b, d = np.concatenate(one), np.concatenate(two), np.concatenate(least)
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    first = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    smallest = np.minimum.reduceat(d[order], np.flatnonzero(first))[np.cumsum(first) - 1]
    out = np.empty(len(d), dtype=bool)
    out[order] = smallest < d[order]
    return [bits(x) for x in np.split(out, size)]


def _repeats(row, window: int, width: int):
    """The packet, and of each word whether it goes."""
    p = Packet(row["body"], window)
    at, number, one, _, least = p.candidates(p.hits(row["blocks"], *p.probes(), width))
    change = np.zeros(len(p.values) + 1, dtype=np.int64)
    if len(at):
        gone = at[(p.named[p.doc[at]] > p.named[least[number]]) | _joined(row["windows"], one, width)[number]]
        np.add.at(change, gone, 1)
        np.add.at(change, gone + window, -1)
    return p, np.cumsum(change)[:-1] > 0


def _runs(gone: np.ndarray) -> list[dict]:
    edge = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
    return [{"first": int(a), "end": int(b)} for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))]


_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))


def _told(rows: DataFrame, window: int) -> tuple[DataFrame, int]:
    if window < 2:
        raise ValueError("a repeat has two words at least")
    packets = packed(rows, lambda t: (to_bytes(t), t.nbytes // 6))  # about a word
    width = bucket_bits(packets)
    hits = packets.join(answered(packets, _ask_blocks(window, width), _answer_blocks, "blocks"), "packet", "left")
    return hits.join(answered(hits, _ask_windows(window, width), _answer_windows, "windows"), "packet", "left"), width


def find_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(doc_id, text)`` to doc_id, n_words, repeats (array of the first word and the end of each run that
    goes), kept (the other words, joined by one space)."""
    told, width = _told(docs.select(F.col("doc_id").cast("long"), "text"), window)
    columns = told.columns

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                p, gone = _repeats({c: b.column(k)[i].as_py() for k, c in enumerate(columns)}, window, width)
                spans, kept = [], []
                for d, words in enumerate(p.words):
                    own = gone[p.begin[d] : p.begin[d + 1]]
                    spans.append(_runs(own) if own.any() else [])
                    kept.append(b" ".join([w for w, g in zip(words, own.tolist()) if not g] if spans[-1] else words).decode("utf-8", "surrogatepass"))
                out = [pa.array(p.ids, pa.int64()), pa.array(p.n), pa.array(spans, _SPANS), pa.array(kept, pa.string())]
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "n_words", "repeats", "kept"])

    return told.mapInArrow(run, "doc_id long, n_words long, repeats array<struct<first: bigint, end: bigint>>, kept string")


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents, all columns kept, with the text's other words joined by one space where a run goes,
    and as it was where none does."""
    row, named = free_name(docs.columns, "_row"), free_name(docs.columns, "_kept")
    rows = cut(docs.withColumn(row, F.monotonically_increasing_id()))
    told, width = _told(rows.select(F.col("doc_id").cast("long"), "text", row), window)
    columns = told.columns

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                p, gone = _repeats({c: b.column(k)[i].as_py() for k, c in enumerate(columns)}, window, width)
                own = [gone[p.begin[d] : p.begin[d + 1]] for d in range(len(p.words))]
                some = [d for d, g in enumerate(own) if g.any()]
                kept = [b" ".join([w for w, g in zip(p.words[d], own[d].tolist()) if not g]).decode("utf-8", "surrogatepass") for d in some]
                yield pa.RecordBatch.from_arrays([pa.array([p.keep[d] for d in some], pa.int64()), pa.array(kept, pa.string())], [row, named])

    found = told.mapInArrow(run, T.StructType([T.StructField(row, T.LongType()), T.StructField(named, T.StringType())]))
    out = rows.join(found, row, "left").withColumn("text", F.coalesce(named, "text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(named).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns)


def op13_block_repeats(spark, sf_dir: str) -> DataFrame:
    found = find_repeats(table(spark, sf_dir, "documents"))
    gone = F.aggregate("repeats", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["first"])
    return found.select("doc_id", "n_words", gone.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents
), w AS (
  SELECT rid, doc_id, i, md5(array_to_string(list_slice(ws, i, i + 49), ' ')) AS win FROM (SELECT rid, doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM d WHERE len(ws) >= 50)
), least AS (
  SELECT win, min(doc_id) AS first FROM w GROUP BY win
), gone AS (
  SELECT DISTINCT rid, unnest(range(i, i + 50)) AS k FROM w JOIN least USING (win) WHERE first < coalesce(doc_id, 9223372036854775807)
), words AS (
  SELECT rid, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS k FROM d
), kept AS (
  SELECT rid, count(*) AS n, string_agg(word, ' ' ORDER BY k) AS text FROM words ANTI JOIN gone USING (rid, k) GROUP BY rid
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (rid)
"""
