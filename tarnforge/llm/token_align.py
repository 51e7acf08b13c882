"""Cross-tokenizer alignment: groups of tokens of two tokenizers that cover the same bytes.

A text with a space before it is encoded by a byte-level BPE (A) and by a piece model (B). Bytes at
which tokens of both end cut them into groups; all tokens of A and of B in a group are linked.

Each run of documents is laid out on one axis of bytes and handed to DuckDB inside the task as tables
of token intervals: the common ends are a join of both, the group of an A token is a running sum of
common ends (window), that of a B token an ASOF join to the next common end (the range join of tokens and groups: as groups don't
overlap, each token lies in one), and links are a join by group. Of a run its packet keeps, compressed, the
documents' figures, the different id pairs with the number of its documents that have them linked, and
which pairs each document has how often. These partial counts are merged by Spark, which gives each
pair its count in the corpus and whether it is its A id's highest; the packets ask for the pairs they
have, by buckets of pairs, and are told. No text is read twice, and no table of pairs is broadcast.

Pieces between which no merge can happen are encoded once and kept by a worker while they are few: the
matches of A's pattern, and B's runs of spaces with what follows, if the model has no piece with a
space after another character and changes no text (else B encodes whole texts).

Defined cases: null, empty and wordless-but-for-changes texts (those whose tokens' bytes differ from the
text's, such as texts with U+2581) have no tokens, zeros and an empty digest; strings of special
tokens are plain text; long texts count whole; a null id is kept, repeated rows are documents of their
own; equal counts of one A id are all its highest; an empty table gives no rows; other columns, of any name, are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnforge.llm.common import cut, small_batches, table
from tarnforge.llm.packets import bucket_bits, from_bytes, grown, packed, shrunk, to_bytes

#: Characters of pieces that a worker keeps of one tokenizer, about.
CACHE = 1 << 22
SPACE = "▁"
#: Bits of an id in a number of two ids, or of a document and two ids.
ID_BITS = 20
_PAIR = (1 << 2 * ID_BITS) - 1
#: Characters of texts on one axis, about; a longer text is alone on its own.
RUN_CHARS = 1 << 20
_HEX = re.compile(r"<0x([0-9A-F]{2})>")
_SEGMENT = re.compile(r" *[^ ]+| +")
_loaded: dict = {}


class _Numbers(dict):
    """Numbers of pieces in the order in which they are first asked for; ``new`` has those not yet encoded."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        self.new.append(piece)
        self[piece] = n = len(self)
        return n


class Pieces:
    """Pieces of text and their tokens: ids and lengths in bytes of each, and whether the bytes are the piece's."""

    def __init__(self, encode, size_of):
        self.encode, self.size_of = encode, size_of
        self.clear()

    def clear(self) -> None:
        self.number = _Numbers()
        self.chars = 0
        self.ids = np.zeros(0, dtype=np.int32)
        self.count, self.same = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool)

    def learn(self) -> None:
        new, self.number.new = self.number.new, []
        if new:
            got = self.encode(new)
            self.chars += sum(map(len, new))
            self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(ids for ids, _ in got), dtype=np.int32)])
            self.count = np.concatenate([self.count, [len(ids) for ids, _ in got]])
            self.same = np.concatenate([self.same, [same for _, same in got]])

    def tokens(self, texts: list[list[str]]):
        """Ids, lengths and the document of each token, and of each text whether its tokens' bytes are its own."""
        if self.chars > CACHE:
            self.clear()
        n = np.array([len(t) for t in texts], dtype=np.int64)
        of = np.fromiter(map(self.number.__getitem__, chain.from_iterable(texts)), dtype=np.int64, count=int(n.sum()))
        self.learn()
        doc = np.repeat(np.arange(len(texts)), n)
        same = np.ones(len(texts), dtype=bool)
        same[doc[~self.same[of]]] = False
        count, begin = self.count[of], (np.cumsum(self.count) - self.count)[of]
        at = np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(count.sum())
        ids = self.ids[at]
        return ids, self.size_of[ids], np.repeat(doc, count), same


def byte_level(path: str, pattern: str):
    """Cutter and pieces of a byte-level tokenizer file."""
    import regex
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    if tok.normalizer is not None:
        raise ValueError(f"{path} changes texts before it cuts them")
    tok.encode_special_tokens = True
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in plain)}
    bytes_as, model = set(letters.values()), tok.model
    vocab = tok.get_vocab(with_added_tokens=False)
    sizes = np.zeros(max([*vocab.values(), 0]) + 1, dtype=np.int64)
    for t, i in vocab.items():
        sizes[i] = len(t) if all(c in bytes_as for c in t) else 0
    size_of = sizes.tolist()

    def encode(pieces: list[str]):
        """Ids, and whether they cover all bytes: a byte-level tokenizer that changes no text can only leave some out."""
        out = []
        for p in pieces:
            raw = p.encode("utf-8", "surrogatepass")
            ids = [t.id for t in model.tokenize(raw.decode("latin-1").translate(letters))]
            out.append((ids, sum([size_of[i] for i in ids]) == len(raw)))
        return out

    return regex.compile(pattern).findall, Pieces(encode, sizes)


def piece_model(path: str):
    """Cutter and pieces of a piece model file. Pieces begin with the space that the model puts there."""
    from sentencepiece import SentencePieceProcessor
    from sentencepiece import sentencepiece_model_pb2 as proto

    model, spec = SentencePieceProcessor(model_file=path), proto.ModelProto()
    with open(path, "rb") as f:
        spec.ParseFromString(f.read())
    names = [p.piece for p in spec.pieces]
    raw = [bytes([int(m[1], 16)]) if p.type == p.BYTE and (m := _HEX.fullmatch(p.piece)) else p.piece.replace(SPACE, " ").encode() for p in spec.pieces]
    norm = spec.normalizer_spec
    apart = not any(b == SPACE and a != SPACE for t in names for a, b in zip(t, t[1:])) and norm.name == "identity" and not norm.remove_extra_whitespaces and norm.add_dummy_prefix
    alone = names.index(SPACE) if apart and SPACE in names else None

    def encode(pieces: list[str]):
        got = [[alone] if p == " " and alone is not None else ids for p, ids in zip(pieces, model.encode([p[1:] for p in pieces], num_threads=1))]
        return [(ids, b"".join([raw[i] for i in ids]) == p.encode("utf-8", "surrogatepass")) for p, ids in zip(pieces, got)]

    return _SEGMENT.findall if alone is not None else (lambda text: [text]), Pieces(encode, np.array([len(b) for b in raw], dtype=np.int64))


def _tools(a_path: str, pattern: str, b_path: str):
    """Both tokenizers and a DuckDB connection, once a worker."""
    key = a_path, pattern, b_path
    if key not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import duckdb

        con = duckdb.connect(config={"threads": 1, "memory_limit": "600MB", "temp_directory": ""})
        _loaded[key] = byte_level(a_path, pattern), piece_model(b_path), con
    return _loaded[key]


#: a, b: tokens (n, id, the end of their interval of bytes, d) in the order of bytes. Intervals follow on each other, so that ends say
#: all. A token's group is one more than the common ends before it; {order} is empty if rows come in order.
_GROUPED_A = """
CREATE OR REPLACE TEMP TABLE ga AS SELECT n, d, id, last, ends, CAST(1 - ends + sum(ends) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS INTEGER) AS g
FROM (SELECT a.n, a.d, a.id, a.last, CAST(b.last IS NOT NULL AS INTEGER) AS ends FROM a LEFT JOIN b ON a.last = b.last)
"""
#: The group of a B token is the one whose end is the next at or after its own.
_GROUPED_B = "CREATE OR REPLACE TEMP TABLE gb AS SELECT b.n, b.id, cuts.g FROM b ASOF JOIN (SELECT g, last FROM ga WHERE ends = 1) AS cuts ON b.last <= cuts.last"
_GROUPS = "SELECT d, count(*) AS n FROM ga WHERE ends = 1 GROUP BY d"
_LINKS = f"SELECT (CAST(ga.d AS BIGINT) << {2 * ID_BITS}) | (CAST(ga.id AS BIGINT) << {ID_BITS}) | gb.id AS link FROM ga JOIN gb USING (g)"


def align(con, a, b, n_docs: int):
    """``a``, ``b``: ids, ends on one axis and documents of tokens. Returns of each document its groups' number, links (d, a, b
    as one number) with how often they are, and groups of the A and B tokens."""
    small = np.int32 if a[1][-1] < 1 << 31 else np.int64
    for name, (ids, last, doc) in (("a", a), ("b", b)):
        con.register(name, pa.table({"n": np.arange(len(ids), dtype=np.int32), "id": ids, "last": last.astype(small), "d": doc.astype(np.int32)}))
    for order in ("", "ORDER BY n"):
        con.execute(_GROUPED_A.format(order=order))
        got = con.execute("SELECT n, g FROM ga").fetchnumpy()
        if (np.diff(got["n"]) > 0).all():  # the running sum was taken in this order
            break
    of = [_placed(got["n"], got["g"])]
    con.execute(_GROUPED_B)
    got = con.execute("SELECT n, g FROM gb").fetchnumpy()
    of.append(_placed(got["n"], got["g"]))
    groups = np.zeros(n_docs, dtype=np.int64)
    got = con.execute(_GROUPS).fetchnumpy()
    groups[got["d"]] = got["n"]
    links = np.unique(np.asarray(con.execute(_LINKS).fetchnumpy()["link"]), return_counts=True)
    con.unregister("a")
    con.unregister("b")
    return groups, links, *of


def _placed(place: np.ndarray, values: np.ndarray) -> np.ndarray:
    out = np.empty(len(place), dtype=np.int64)
    out[place] = values
    return out


@lru_cache(maxsize=4)
def _marked(bits: int) -> np.ndarray:
    """Ids of so many bits as text, each with a comma, a bar and a semicolon after it."""
    return np.array([f"{i}{m}" for i in range(1 << bits) for m in ",|;"], dtype=object)


def group_texts(ids_a, ga, doc_a, ids_b, gb, n_docs: int) -> list[str]:
    """``a1,a2|b1;a3|b2,b3`` of each document."""
    side = np.concatenate([np.zeros(len(ga), dtype=np.int64), np.ones(len(gb), dtype=np.int64)])
    g = np.concatenate([ga, gb])
    order = np.argsort(2 * g + side, kind="stable")
    ids, g, side = np.concatenate([ids_a, ids_b])[order], g[order], side[order]
    # After a token: a comma in its side of the group, a bar at the end of A's, a semicolon at the group's.
    after = np.where(np.diff(g, append=-1) != 0, 2, np.where(np.diff(side, append=0) != 0, 1, 0))
    doc_of_group = np.zeros(int(g.max(initial=0)) + 1, dtype=np.int64)
    doc_of_group[ga] = doc_a
    doc = doc_of_group[g]
    words = _marked(int(ids.max(initial=0)).bit_length())[3 * ids.astype(np.int64) + after]
    edges = np.searchsorted(doc, np.arange(n_docs + 1))
    return ["".join(words[a:b].tolist())[:-1] for a, b in zip(edges, edges[1:])]


def _aligned(texts: list[str], a_path: str, pattern: str, b_path: str):
    """Of each text n_a, n_b, n_groups, n_links and its digest; and the links (d, a, b as one number) with how often they are."""
    (cut_a, a), (cut_b, b), con = _tools(a_path, pattern, b_path)
    figures, digest = np.zeros((4, len(texts)), dtype=np.int64), [""] * len(texts)
    where = np.array([i for i, x in enumerate(texts) if x], dtype=np.int64)
    spaced = [f" {texts[i]}" for i in where.tolist()]
    found = [cut_a(x) for x in spaced], [cut_b(x) for x in spaced]
    got = a.tokens(found[0]), b.tokens(found[1])
    same = got[0][3] & got[1][3]
    if not same.all():
        keep = np.flatnonzero(same).tolist()
        where, spaced = where[keep], [spaced[k] for k in keep]
        got = a.tokens([found[0][k] for k in keep]), b.tokens([found[1][k] for k in keep])
    n = len(where)
    if not n:
        return figures, digest, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    (ids_a, size_a, doc_a, _), (ids_b, size_b, doc_b, _) = got
    groups, (links, times), ga, gb = align(con, (ids_a, np.cumsum(size_a), doc_a), (ids_b, np.cumsum(size_b), doc_b), n)
    of_doc = links >> 2 * ID_BITS
    for row, x in zip(figures, (np.bincount(doc_a, minlength=n), np.bincount(doc_b, minlength=n), groups, np.bincount(of_doc, times, n))):
        row[where] = x
    for i, x in zip(where.tolist(), group_texts(ids_a, ga, doc_a, ids_b, gb, n)):
        digest[i] = hashlib.sha256(x.encode()).hexdigest()
    return figures, digest, (where[of_doc] << 2 * ID_BITS) | (links & _PAIR), times


def _runs(texts: list[str | None]):
    """Slices of about ``RUN_CHARS`` characters: what is laid out on one axis at once."""
    begin = size = 0
    for i, x in enumerate(texts):
        if size and size + len(x or "") > RUN_CHARS:
            yield begin, i
            begin, size = i, 0
        size += len(x or "")
    yield begin, len(texts)


def _pack(a_path: str, pattern: str, b_path: str):
    def pack(t: pa.Table):
        texts = t.column(1).to_pylist()
        figures, digest, links, times = [], [], [], []
        for i, j in _runs(texts):
            f, g, k, m = _aligned(texts[i:j], a_path, pattern, b_path)
            figures.append(f)
            digest += g
            links.append(k + (i << 2 * ID_BITS))
            times.append(m)
        links, times, figures = np.concatenate(links), np.concatenate(times), np.concatenate(figures, axis=1)
        pairs, of, counts = np.unique(links & _PAIR, return_inverse=True, return_counts=True)
        size = np.bincount(links >> 2 * ID_BITS, minlength=len(texts))
        lists = np.concatenate([[0], np.cumsum(size)])
        docs = pa.table({
            "doc_id": t.column(0).combine_chunks(), **dict(zip(("n_a", "n_b", "n_groups", "n_links"), figures)), "groups_sha256": pa.array(digest, pa.string()),
            "pair": pa.LargeListArray.from_arrays(lists, pa.array(of.astype(np.int32))), "m": pa.LargeListArray.from_arrays(lists, pa.array(times.astype(np.int32))),
        })
        first, second = to_bytes(docs), to_bytes(pa.table({"pair": pairs.astype(np.int64), "n": counts.astype(np.int64)}))
        return np.int64(len(first)).tobytes() + first + second, len(pairs)

    return pack


def _parts(body) -> tuple[pa.Table, pa.Table]:
    n = int(np.frombuffer(body, np.int64, 1)[0])
    return from_bytes(memoryview(body)[8 : 8 + n]), from_bytes(memoryview(body)[8 + n :])


def _bucket(pairs: np.ndarray, bits: int) -> np.ndarray:
    mixed = pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(63 - bits) >> np.uint64(1)).astype(np.int64)


def pair_counts(packets: DataFrame) -> DataFrame:
    """a, b, n (documents that have the pair linked), best: n is the highest of the A id."""
    def run(batches):
        for b in batches:
            for x in b.column(0):
                yield from _parts(x.as_py())[1].to_batches(max_chunksize=1 << 16)

    counts = cut(packets.select("body").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).select(
        F.shiftright("pair", ID_BITS).alias("a"), F.col("pair").bitwiseAND(F.lit((1 << ID_BITS) - 1)).alias("b"), "n"))
    return counts.join(counts.groupBy("a").agg(F.max("n").alias("most")), "a").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def with_counts(packets: DataFrame, counts: DataFrame) -> DataFrame:
    """Packets with told: array of (bucket, body), the counts of their pairs by bucket."""
    width = bucket_bits(packets)

    def ask(batches):
        for b in batches:
            for body, packet in zip(b.column(0), b.column(1)):
                pairs = _parts(body.as_py())[1]["pair"].to_numpy()
                bucket = _bucket(pairs, width)
                for k in np.unique(bucket).tolist():
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([packet.as_py()], pa.int64()), pa.array([shrunk(pairs[bucket == k])], pa.binary())], ["bucket", "packet", "body"])

    def deal(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_bucket(b.column(0).to_numpy(), width)), *b.columns], ["bucket", "pair", "n", "best"])

    def tell(asks: pa.Table, known: pa.Table) -> pa.Table:
        pair = known["pair"].to_numpy()
        order = np.argsort(pair)
        pair, n, best = pair[order], known["n"].to_numpy()[order], known["best"].to_numpy(zero_copy_only=False)[order]
        told = []
        for raw in asks["body"].to_pylist():
            at = np.searchsorted(pair, grown(raw, np.int64))
            told.append((n[at] * 2 + best[at]).astype(np.int64).tobytes())
        return pa.table({"packet": asks["packet"], "bucket": asks["bucket"], "body": pa.array(told, pa.binary())})

    asks = packets.select("body", "packet").mapInArrow(ask, "bucket long, packet long, body binary")
    known = counts.select((F.shiftleft("a", ID_BITS).bitwiseOR(F.col("b"))).alias("pair"), "n", "best").mapInArrow(deal, "bucket long, pair long, n long, best boolean")
    replies = asks.groupBy("bucket").cogroup(known.groupBy("bucket")).applyInArrow(tell, "packet long, bucket long, body binary")
    told = replies.groupBy("packet").agg(F.collect_list(F.struct("bucket", "body")).alias("told"))
    return packets.join(cut(told), "packet", "left")


def align_documents(docs: DataFrame, a_path: str, pattern: str, b_path: str) -> DataFrame:
    """``(doc_id, text)`` to doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType
    packets = packed(docs.select("doc_id", "text"), _pack(a_path, pattern, b_path))
    width, told = bucket_bits(packets), with_counts(packets, pair_counts(packets)).select("body", "told")
    figures = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    names = ["doc_id", *figures, "n_best", "count_sum"]

    def run(batches):
        for b in batches:
            for body, replies in zip(b.column(0), b.column(1)):
                rows, pairs = _parts(body.as_py())
                rows, pair = rows.combine_chunks(), pairs["pair"].to_numpy()
                bucket, count = _bucket(pair, width), np.zeros(len(pair), dtype=np.int64)
                for r in replies.as_py() or []:
                    count[bucket == r["bucket"]] = np.frombuffer(r["body"], np.int64)
                of, m = (rows[c].combine_chunks() if isinstance(rows[c], pa.ChunkedArray) else rows[c] for c in ("pair", "m"))
                doc = np.repeat(np.arange(len(of)), of.value_lengths().to_numpy(zero_copy_only=False))
                of, m = of.flatten().to_numpy(), m.flatten().to_numpy()
                best, total = np.zeros(rows.num_rows, dtype=np.int64), np.zeros(rows.num_rows, dtype=np.int64)
                np.add.at(best, doc, m.astype(np.int64) * (count[of] & 1))
                np.add.at(total, doc, m.astype(np.int64) * (count[of] >> 1))
                columns = [rows[c].combine_chunks() if isinstance(rows[c], pa.ChunkedArray) else rows[c] for c in ("doc_id", *figures)]
                yield pa.RecordBatch.from_arrays([x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in columns] + [pa.array(best), pa.array(total)], names)

    return told.mapInArrow(run, f"doc_id {kind.simpleString()}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long")


def op12_token_align(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers as public

    return align_documents(table(spark, sf_dir, "documents"), public.path("byte_bpe_50k.json"), public.PATTERN, public.path("piece_bpe_32k.model"))
