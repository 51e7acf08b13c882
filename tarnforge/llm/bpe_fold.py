"""Byte-level BPE encoding and decoding with Spark higher-order functions.

A rank file becomes a literal map, a row of arrays in the query: a hash table in which each byte string has
one of three slots, so that a lookup reads at most three array elements. Encoding folds the ranked merges over the byte array of a word: the state holds
the pieces and the rank of each neighbouring pair, and each step joins the leftmost pair of
lowest rank and renews its two neighbours, until no pair has a rank.

Distinct pre-tokens are counted over all documents, and the ``FREQUENT`` most frequent ones (seen
twice or more, of at most ``LONGEST`` bytes) are folded once by Spark and broadcast. The documents' pre-tokens
are looked up there, so that none is shuffled back to its document. The fold takes 77 to 134
microseconds a rare word, too many for the millions of rare words (see the README); a worker
encodes those by the tokenizer's library, each once, in a bounded cache. Decoding is
a higher-order function again: it looks up the binary piece of each id and concatenates the
pieces.

Byte strings are held as strings of one character (U+0000 to U+00FF) for each byte; ISO-8859-1
takes them from and to binary.

Defined cases: a null text is empty and has no ids; whole texts are encoded whatever their
length; a null id is kept; special strings are ordinary text; repeated rows stay repeated; an empty table
gives no rows; other columns stay, but for an earlier ``ids``, which is replaced.
"""

from __future__ import annotations

import base64
import uuid
from array import array

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnforge.llm.common import free_name, small_batches, table

FREQUENT, LONGEST, CACHE = 1 << 17, 48, 1 << 17
NONE = 2**31 - 1
#: What the tokenizer's ``\s`` means, for Java's patterns, where it is ASCII only.
SPACE = r"\t-\r \x85\xA0  -     　"


def java_pattern(pattern: str) -> str:
    return pattern.replace(r"[^\s", rf"[^{SPACE}").replace(r"\s", rf"[{SPACE}]").replace(r"\S", rf"[^{SPACE}]")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _hashes(key: str) -> int:
    """The hash that ``xxhash64`` of one string column gives, unsigned."""
    import xxhash

    return xxhash.xxh64_intdigest(key.encode(), 42)


def place(entries: dict[str, int]) -> tuple[list[str], list[int]]:
    """Cuckoo placement: each key in one of its three slots. Keys and values by slot; "" is free."""
    size = max(8, int(len(entries) * 1.25))
    while True:
        keys, values, room = [""] * size, [0] * size, True
        for turn, (key, value) in enumerate(entries.items()):
            for k in range(500):
                h = _hashes(key)
                slots = (h >> 1) % size, (h >> 21) % size, (h >> 42) % size
                free = next((s for s in slots if not keys[s]), None)
                at = slots[(turn + k) % 3] if free is None else free
                keys[at], key, values[at], value = key, keys[at], value, values[at]
                if free is not None:
                    break
            else:
                room = False
                break
        if room:
            return keys, values
        size = size * 5 // 4


def literal_row(arrays: dict[str, tuple[list, str]]) -> Column:
    """Literal arrays (values and their Arrow type, by name) as a struct. The query holds them as a local
    relation of one row, and reads it as a scalar subquery: as literals of an expression they would
    stand in the text of every plan and of each of its updates, megabytes that the driver writes and keeps.
    To be projected as a column that one higher-order function reads; the optimizer then joins both
    projections, so that no row carries the arrays."""
    import pyarrow as pa

    row = pa.table({n: pa.array([v], pa.list_(getattr(pa, kind)())) for n, (v, kind) in arrays.items()})
    return SparkSession.active().createDataFrame(row).select(F.struct(*arrays).alias("row")).scalar()


class LiteralMap:
    """A map of non-empty strings as two literal arrays.

    ``arrays`` is bound once by the caller (see ``let``) and handed back to ``get``, so that a
    plan holds one copy of it.
    """

    def __init__(self, entries: dict[str, int]):
        keys, values = place(entries)
        self.size = len(keys)
        self.arrays = literal_row({"keys": (keys, "string"), "values": (values, "int32")})

    def get(self, arrays: Column, key: Column) -> Column:
        """The value, or null."""
        def at_slot(at: Column, other: Column) -> Column:
            return let(at, lambda a: F.when(F.element_at(arrays["keys"], a) == key, F.element_at(arrays["values"], a)).otherwise(other))

        def probe(h: Column) -> Column:
            out = F.lit(None)
            for k in (42, 21, 1):
                out = at_slot(F.pmod(F.shiftrightunsigned(h, k), F.lit(self.size)).cast("int") + 1, out)
            return out

        return let(F.xxhash64(key), probe)


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


class Bpe:
    """Functions of one vocabulary. ``t`` is the bound ``tables``."""

    def __init__(self, ranks: dict[bytes, int]):
        by_id = [""] * (max(ranks.values(), default=-1) + 1)
        for b, r in ranks.items():
            by_id[r] = b.decode("latin-1")
        self.ranks = LiteralMap({b.decode("latin-1"): r for b, r in ranks.items()})
        self.tables = self.ranks.arrays
        self.pieces = literal_row({"pieces": (by_id, "string")})

    def rank(self, t: Column, piece: Column) -> Column:
        return F.coalesce(self.ranks.get(t, piece), F.lit(NONE))

    def merged(self, t: Column, word: Column) -> Column:
        """Pieces of a word, by folding the merges over its bytes."""
        none = F.array().cast("array<int>")

        def step(acc: Column, _: Column) -> Column:
            def join(v: Column) -> Column:
                parts, ranks, at = acc["parts"], acc["ranks"], v["at"]
                size = F.size(parts)
                left = F.when(at > 1, F.array(self.rank(t, F.concat(F.element_at(parts, at - 1), v["piece"])))).otherwise(none)
                right = F.when(at + 2 <= size, F.array(self.rank(t, F.concat(v["piece"], F.element_at(parts, at + 2))))).otherwise(none)
                return F.struct(
                    F.concat(F.slice(parts, F.lit(1), at - 1), F.array(v["piece"]), F.slice(parts, at + 2, size)).alias("parts"),
                    F.concat(F.slice(ranks, F.lit(1), F.greatest(at - 2, F.lit(0))), left, right, F.slice(ranks, at + 2, size)).alias("ranks"),
                )

            def found(low: Column) -> Column:
                at = F.array_position(acc["ranks"], low).cast("int")
                return F.when(low < NONE, let(at, lambda a: let(F.struct(a.alias("at"), F.concat(F.element_at(acc["parts"], a), F.element_at(acc["parts"], a + 1)).alias("piece")), join))).otherwise(acc)

            return let(F.array_min(acc["ranks"]), found)

        start = let(F.split(word, ""), lambda p: F.struct(
            p.alias("parts"),
            F.when(F.size(p) > 1, F.zip_with(F.slice(p, F.lit(1), F.size(p) - 1), F.slice(p, F.lit(2), F.size(p) - 1), lambda a, b: self.rank(t, F.concat(a, b)))).otherwise(none).alias("ranks"),
        ))
        steps = F.when(F.length(word) > 1, F.sequence(F.lit(1), F.length(word) - 1)).otherwise(none)
        return F.aggregate(steps, start, step, lambda acc: acc["parts"])

    def encode_word(self, t: Column, word: Column) -> Column:
        """Ids of one pre-token, comma-joined."""
        raw = F.decode(F.encode(word, "UTF-8"), "ISO-8859-1")
        return let(raw, lambda w: F.coalesce(self.ranks.get(t, w).cast("string"), F.array_join(F.transform(self.merged(t, w), lambda p: self.ranks.get(t, p).cast("string")), ",")))

    def encoded(self, df: DataFrame, word: str, name: str) -> DataFrame:
        """Adds the ids of the words of a column."""
        held = free_name(df.columns, "_tables")
        rows = df.withColumn(held, self.tables)
        return rows.select(*df.columns, let(F.col(held), lambda t: self.encode_word(t, F.col(word))).alias(name))

    def decoded(self, df: DataFrame, ids: str, name: str) -> DataFrame:
        """Adds the binary of arrays of ids: the binary pieces, concatenated."""
        held = free_name(df.columns, "_pieces")
        rows = df.withColumn(held, self.pieces)
        joined = let(F.col(held), lambda p: F.array_join(F.transform(ids, lambda i: F.get(p["pieces"], i)), ""))
        return rows.select(*df.columns, F.encode(joined, "ISO-8859-1").alias(name))


def count_words(docs: DataFrame, pattern: str) -> DataFrame:
    """Pre-tokens of all documents that occur twice or more, with their counts."""
    words = docs.select(F.explode(F.regexp_extract_all("text", F.lit(java_pattern(pattern)), F.lit(0))).alias("w"))
    return words.groupBy("w").agg(F.count("*").alias("n")).where("n >= 2")


def most_frequent(counted: DataFrame, most: int) -> DataFrame:
    """At most ``most`` of the words: all whose count is above a bound found from the counts of counts."""
    left, bound = most, None
    for r in counted.groupBy("n").agg(F.count("*").alias("k")).orderBy(F.desc("n")).limit(most).collect():
        left -= r["k"]
        if left < 0:
            break
        bound = r["n"]
    return counted.where(F.col("n") >= bound) if bound is not None else counted.limit(0)


def encoded_words(docs: DataFrame, bpe: Bpe, pattern: str) -> bytes:
    """The most frequent pre-tokens and their ids, folded by Spark, as one Arrow stream of bounded size.
    The ids of a word are held as the bytes of 32-bit numbers."""
    import pyarrow as pa

    # Read twice, for the bound and for the words; lost parts are computed again.
    counted = count_words(docs, pattern).where(F.octet_length("w") <= LONGEST).persist(StorageLevel.DISK_ONLY)
    try:
        folded = bpe.encoded(most_frequent(counted, FREQUENT).select("w"), "w", "ids").toArrow()
    finally:
        counted.unpersist()
    out = pa.BufferOutputStream()
    names = ["w", "ids"]
    with pa.ipc.new_stream(out, pa.schema([("w", pa.string()), ("ids", pa.binary())])) as stream:
        for b in folded.to_batches():
            ids = pa.array([np.array(x.split(","), dtype=np.int32).tobytes() for x in b.column(1).to_pylist()], pa.binary())
            stream.write_batch(pa.RecordBatch.from_arrays([b.column(0), ids], names))
    return out.getvalue().to_pybytes()


class Words(dict):
    """The ids of known words, as bytes; any other word is encoded when it is asked for. Rare words of
    at most ``LONGEST`` characters are kept in a cache that is emptied when it holds ``CACHE``."""

    def __init__(self, stream: bytes, encode):
        import pyarrow as pa

        for b in pa.ipc.open_stream(stream):
            self.update(zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        self.encode, self.rare = encode, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.rare.get(word)
        if ids is None:
            ids = array("i", self.encode(word)).tobytes()
            if len(word) <= LONGEST:
                if len(self.rare) >= CACHE:
                    self.rare.clear()
                self.rare[word] = ids
        return ids


_loaded: dict = {}


def _library(path: str, pattern: str):
    """The library's encoder of this rank file, once a worker."""
    if (path, pattern) not in _loaded:
        import regex
        import tiktoken

        _loaded[path, pattern] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={}), regex.compile(pattern)
    return _loaded[path, pattern]


def encode_documents(docs: DataFrame, path: str, pattern: str, bpe: Bpe | None = None) -> DataFrame:
    """All columns of ``docs`` but text, which becomes ``ids``, the array of its token ids."""
    import pyarrow as pa
    from pyspark.sql import types as T

    docs = docs.drop("ids")
    small_batches(docs.sparkSession)
    shared, token = docs.sparkSession.sparkContext.broadcast(encoded_words(docs, bpe or Bpe(read_ranks(path)), pattern)), uuid.uuid4().hex
    at = docs.columns.index("text")

    def run(batches):
        encoder, pieces = _library(path, pattern)
        words = _loaded.get(token)
        if words is None:  # once a worker; an earlier table is let go
            for old in [k for k in _loaded if isinstance(k, str)]:
                del _loaded[old]
            words = _loaded[token] = Words(shared.value, encoder.encode_ordinary)
        for b in batches:
            flat, sizes = [], [0]
            for x in b.column(at):
                flat.append(np.frombuffer(b"".join(map(words.__getitem__, pieces.findall(x.as_py() or ""))), dtype=np.int32))
                sizes.append(sizes[-1] + len(flat[-1]))
            ids = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int32)))
            yield pa.RecordBatch.from_arrays([ids if i == at else b.column(i) for i in range(b.num_columns)], names)
        words.rare.clear()  # an idle worker holds no rare words

    names = ["ids" if c == "text" else c for c in docs.columns]
    kinds = T.StructType([T.StructField(n, T.ArrayType(T.IntegerType()) if i == at else f.dataType) for i, (n, f) in enumerate(zip(names, docs.schema.fields))])
    return docs.mapInArrow(run, kinds)


def op8_bpe_fold(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers as public

    path = public.path("byte_bpe_multi_50k.tiktoken")
    bpe = Bpe(read_ranks(path))
    out = encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), path, public.PATTERN, bpe)
    return bpe.decoded(out, "ids", "raw").select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("raw", 256).alias("decoded_sha256"),
    )
