"""Benchmark decontamination: an FM-index of each training shard, searched for test phrases.

A shard is a run of documents of one partition, of about ``SHARD_BYTES`` bytes. Its alphabet is
the benchmark's words; all other words are one separator symbol, and runs of benchmark words
shorter than the shortest phrase are left out, as no phrase can lie in them. Each phrase
(a window of ``WINDOW`` words of an item, or the whole of a shorter item) is searched backward
through the wavelet matrix, its occurrences are located by sampled suffix positions, and the
words inside are merged to removal spans. All documents are searched, whole, in one pass with
no shuffle.

The benchmark goes to the workers in blocks of at most ``BLOCK_WORDS`` words and the window's
overlap. The driver reads it a partition at a time and holds one block; a worker loads one
block at a time, searches the shard for it and lets it go, so that neither's memory grows with
the benchmark. The hits of all blocks are joined before anything is cut, and a text that was
cut is searched again for all blocks: the result does not depend on where blocks begin.

Defined cases: a null or wordless text has no words; null or wordless items have no phrases
and never occur; equal item ids count once; an item with a null id is searched and hit like
any other, but is not among the items named; a null document id is kept as it is; repeated
documents stay repeated; texts of any length are one piece of a shard, which is then as long
as they are; an empty benchmark leaves all documents clean; an empty table gives no rows;
other columns, of any name, are ignored by ``find_contamination`` and kept by ``decontaminate``.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnforge.llm.common import small_batches, table
from tarnforge.llm.fm_index import FMIndex

WINDOW, SHARD_BYTES, BLOCK_WORDS = 10, 16 << 20, 1_000_000
_STEP, _NO_PLACE = 1 << 16, np.zeros(0, dtype=np.int64)
#: A-Z to lower case; bytes that belong to no word to blanks.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile(rb"[^ ]+")


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


class Phrases:
    """The windows of a block of items: the words as numbers, and by length where different windows begin
    and which list of items has each. Windows that many items share are one, and so is a list that many windows have."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int = WINDOW):
        self.symbols: dict[bytes, int] = {}  # 0 ends a text, 1 separates
        names: dict[str | None, int] = {}
        words, begins, owners = [], {}, {}
        at = 0
        for item, text in items:
            n = min(len(text), window)
            if not n:
                continue
            words.append(np.fromiter((self.symbols.setdefault(w, len(self.symbols) + 2) for w in text), dtype=np.int32, count=len(text)))
            begins.setdefault(n, []).append(np.arange(at, at + len(text) - n + 1))
            owners.setdefault(n, []).append(np.full(len(text) - n + 1, names.setdefault(item, len(names)), dtype=np.int32))
            at += len(text)
        self.words = np.concatenate(words) if words else np.zeros(0, dtype=np.int32)
        #: Names of each list's items; those of one item come first.
        self.lists = [np.array([k], dtype=np.int32) for k in range(len(names))]
        self.names = list(names)
        self.by_length = {n: self._different(n, np.concatenate(begins[n]), np.concatenate(owners[n])) for n in sorted(begins)}
        self.shortest = min(self.by_length, default=0)

    def _different(self, n: int, begins: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the windows of one length, where each different one begins, and its list."""
        rows = np.ascontiguousarray(self.words[begins[:, None] + np.arange(n)]).view(np.dtype((np.void, 4 * n))).ravel()
        _, first, number = np.unique(rows, return_index=True, return_inverse=True)
        pairs = np.unique(number.astype(np.int64) * len(self.names) + owners)  # of a window and an item, in order
        window, item = pairs // len(self.names), (pairs % len(self.names)).astype(np.int32)
        edge = np.searchsorted(window, np.arange(len(first) + 1))
        lists = item[edge[:-1]].astype(np.int64)
        known: dict[bytes, int] = {}
        for k in np.flatnonzero(np.diff(edge) > 1).tolist():
            own = item[edge[k] : edge[k + 1]]
            lists[k] = known.setdefault(own.tobytes(), len(self.lists))
            if lists[k] == len(self.lists):
                self.lists.append(own)
        return begins[first], lists

    def patterns(self):
        """Windows of one length, some at a time: their symbols and their lists."""
        for n, (begins, lists) in self.by_length.items():
            for k in range(0, len(begins), _STEP):
                yield n, self.words[begins[k : k + _STEP, None] + np.arange(n)].astype(np.int64), lists[k : k + _STEP]


def search_shard(texts: list[list[bytes]], phrases: Phrases, named: bool = True) -> list[tuple[np.ndarray, frozenset[int]]]:
    """Of each text (its words): sorted places of the words that are hit, and the lists of items found (none unless ``named``)."""
    flat, owner, place = [], [], []
    get = phrases.symbols.get
    hits, lists = [_NO_PLACE] * len(texts), [set() for _ in texts]
    if not phrases.by_length:
        return [(h, frozenset()) for h in hits]
    for d, words in enumerate(texts):
        if not words:
            continue
        ids = np.fromiter((get(w, 1) for w in words), dtype=np.int32, count=len(words))
        known = np.concatenate([[False], ids > 1, [False]])
        begin, end = np.flatnonzero(known[1:] & ~known[:-1]), np.flatnonzero(known[:-1] & ~known[1:])
        long_enough = end - begin >= phrases.shortest
        for a, b in zip(begin[long_enough].tolist(), end[long_enough].tolist()):
            flat.append(ids[a:b])
            flat.append(np.ones(1, dtype=np.int32))
            owner.append(np.full(b - a + 1, d))
            place.append(np.arange(a, b + 1))
    if flat:
        owner, place = np.concatenate(owner), np.concatenate(place)
        index = FMIndex(np.concatenate(flat), len(phrases.symbols) + 2)
        change = np.zeros(index.n + 1, dtype=np.int64)
        for n, patterns, of in phrases.patterns():
            low, high = index.search(patterns)
            some = np.flatnonzero(high > low)
            at, which = index.locate(low[some], high[some])
            np.add.at(change, at, 1)
            np.add.at(change, at + n, -1)
            if named:
                for pair in np.unique(owner[at] * len(phrases.lists) + of[some[which]]).tolist():
                    lists[pair // len(phrases.lists)].add(pair % len(phrases.lists))
        inside = np.flatnonzero(np.cumsum(change)[: len(owner)] > 0)
        docs, first = np.unique(owner[inside], return_index=True)
        for d, w in zip(docs.tolist(), np.split(place[inside], first[1:])):
            hits[d] = w
    return [(h, frozenset(x)) for h, x in zip(hits, lists)]


def search_blocks(texts: list[list[bytes]], blocks, named: bool = True) -> tuple[list[np.ndarray], list[tuple[str, ...]]]:
    """Hit places and names of the items found in each text, of all blocks joined. Texts that share the same windows have the
    same tuple of names, which is made once."""
    hits, found = [_NO_PLACE] * len(texts), [()] * len(texts)
    names: dict[tuple[int, int], list[str]] = {}
    for k, phrases in enumerate(blocks()):
        for d, (h, lists) in enumerate(search_shard(texts, phrases, named)):
            if len(h):
                hits[d] = np.union1d(hits[d], h) if len(hits[d]) else h
            if lists:
                found[d] += ((k, lists),)
                for x in lists:
                    if (k, x) not in names:
                        names[k, x] = [phrases.names[i] for i in phrases.lists[x].tolist() if phrases.names[i] is not None]
    made: dict[tuple, tuple[str, ...]] = {}
    for key in set(found):
        made[key] = tuple(sorted({n for k, lists in key for x in lists for n in names[k, x]}))
    return hits, [made[key] for key in found]


def removal_spans(text: str, hit) -> list[tuple[int, int]]:
    """Merged byte spans, from the first to the last byte of neighbouring hit words."""
    at = [m.span() for m in _WORD.finditer(text.encode("utf-8", "surrogatepass").translate(_FOLD))]
    spans: list[tuple[int, int]] = []
    last = None
    for w in map(int, hit):
        if last is not None and w == last + 1:
            spans[-1] = spans[-1][0], at[w][1]
        else:
            spans.append(at[w])
        last = w
    return spans


def remove_spans(text: str, spans: list[tuple[int, int]]) -> str:
    raw, out, last = text.encode("utf-8", "surrogatepass"), [], 0
    for a, b in spans:
        out.append(raw[last:a])
        last = b
    return b"".join([*out, raw[last:]]).decode("utf-8", "surrogatepass")


def without_phrases(texts: list[str | None], blocks) -> list[str | None]:
    """The texts without what lies in phrases; where a cut joins words to a new phrase, it is cut in turn."""
    out, todo = list(texts), list(range(len(texts)))
    while todo:
        found, _ = search_blocks([words_of(out[i]) for i in todo], blocks, named=False)
        todo, hits = [i for i, h in zip(todo, found) if len(h)], [h for h in found if len(h)]
        for i, h in zip(todo, hits):
            out[i] = remove_spans(out[i], removal_spans(out[i], h))
    return out


def item_blocks(benchmark: DataFrame, window: int = WINDOW):
    """Items as (id, words), in blocks of at most BLOCK_WORDS words and the overlap of windows. A
    longer item goes on in the next block, from the last window that the one before has not."""
    block, size = [], 0
    for r in benchmark.select(F.col("item_id").cast("string").alias("item"), "text").toLocalIterator():
        words = words_of(r["text"])
        at = 0
        while at < len(words):
            part = words[at : at + max(1, BLOCK_WORDS - size) + window - 1]
            block.append((r["item"], part))
            size += len(part)
            at = len(words) if at + len(part) >= len(words) else at + len(part) - window + 1
            if size >= BLOCK_WORDS:
                yield block
                block, size = [], 0
    if block:
        yield block


def shared_blocks(benchmark: DataFrame, window: int):
    """The blocks as broadcasts. What is returned gives them one after the other, in a worker too,
    which lets each go before it loads the next."""
    sc = benchmark.sparkSession.sparkContext
    held = [sc.broadcast(Phrases(b, window)) for b in item_blocks(benchmark, window)]

    def blocks():
        for b in held:
            yield b.value
            if len(held) > 1 and vars(b).get("_path"):
                vars(b).pop("_value", None)  # it is read again from the executor's own copy of the file

    return blocks


def _shards(batches, text: int):
    """Arrow batches in runs of about SHARD_BYTES of text, with the texts."""
    run, texts, size = [], [], 0
    for b in batches:
        run.append(b)
        texts.extend(b.column(text).to_pylist())
        size += b.column(text).nbytes
        if size >= SHARD_BYTES:
            yield run, texts
            run, texts, size = [], [], 0
    if run:
        yield run, texts


def _with_columns(run, new: dict, kinds: dict, names: list[str]):
    """The batches of a shard with some columns replaced by slices of ``new``."""
    done = 0
    for b in run:
        n = b.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(new[c][done : done + n], kinds[c]) if c in new else b.column(i) for i, c in enumerate(names)], names)
        done += n


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(doc_id, text)`` to doc_id, text, n_words, hits (places of hit words), n_items, item_set, items.

    ``item_set`` is the name of the set of items found, the SHA-256 of their sorted ids joined by commas. The ids themselves are
    in ``items`` at the first document of each shard that has the set, and null at the others: where thousands of
    documents share a window with thousands of items, the lists are not repeated (see ``item_sets``)."""
    small_batches(docs.sparkSession)
    blocks = shared_blocks(benchmark, window)
    nothing = {c: F.lit(None).cast(t).alias(c) for c, t in (("n_words", "long"), ("hits", "array<int>"), ("n_items", "long"), ("item_set", "string"), ("items", "array<string>"))}
    df = docs.select("doc_id", "text", *nothing.values())
    names = df.columns
    kinds = {"n_words": pa.int64(), "hits": pa.list_(pa.int32()), "n_items": pa.int64(), "item_set": pa.string(), "items": pa.list_(pa.string())}

    def run(batches):
        for shard, texts in _shards(batches, 1):
            words = [words_of(t) for t in texts]
            hits, items = search_blocks(words, blocks)
            known: dict[int, str] = {}  # tuples of equal sets are one object
            first = []
            for x in items:
                first.append(None if id(x) in known else x)
                if id(x) not in known:
                    known[id(x)] = hashlib.sha256(",".join(x).encode("utf-8", "surrogatepass")).hexdigest()
            new = {"n_words": [len(w) for w in words], "hits": [h.astype(np.int32) for h in hits], "n_items": [len(x) for x in items], "item_set": [known[id(x)] for x in items], "items": first}
            yield from _with_columns(shard, new, kinds, names)

    return df.mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType) for f in df.schema.fields]))


def item_sets(found: DataFrame) -> DataFrame:
    """item_set, items: each different set of items that documents were found to hold, once."""
    return found.where(F.col("items").isNotNull()).groupBy("item_set").agg(F.any_value("items").alias("items"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Documents with the removal spans cut from their texts; all columns stay. ``n_chars``, where
    present, follows the new text."""
    small_batches(docs.sparkSession)
    blocks = shared_blocks(benchmark, window)
    names, at, before = docs.columns, docs.columns.index("text"), docs.schema

    def run(batches):
        for shard, texts in _shards(batches, at):
            yield from _with_columns(shard, {"text": without_phrases(texts, blocks)}, {"text": pa.string()}, names)

    out = docs.mapInArrow(run, before)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(before["n_chars"].dataType)))
    return out


def op5_fm_decontam(spark, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", F.size("hits").cast("long").alias("n_hit"), "n_items", F.col("item_set").alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"))


OP5_SQL = r"""
WITH w AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark WHERE text IS NOT NULL
), p AS (
  SELECT DISTINCT item, least(10, len(ws)) AS n, list_slice(ws, i, i + least(10, len(ws)) - 1) AS win
  FROM (SELECT item, ws, unnest(range(1, greatest(2, len(ws) - 8))) AS i FROM b WHERE len(ws) > 0)
), d AS (
  SELECT rid, n, i, list_slice(ws, i, i + n - 1) AS win FROM (SELECT rid, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM w, (SELECT DISTINCT n FROM p) WHERE len(ws) >= n)
), h AS (
  SELECT d.rid, d.i, d.n, p.item FROM d JOIN p ON p.n = d.n AND p.win = d.win
), words AS (
  SELECT rid, count(DISTINCT k) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS k FROM h) GROUP BY rid
), items AS (
  SELECT rid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM h GROUP BY rid
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN words USING (rid) LEFT JOIN items USING (rid)
"""
