"""Hard negatives, cross-tokenizer alignment and repeated passages, against plain versions."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as public
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from tarnforge.llm import block_repeats, hard_negatives, packets, token_align

SPLIT = re.compile("[^\x20\x09-\x0d]+")
A_PATH, B_PATH = public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model")


def rows(df):
    return [tuple(r) for r in df.collect()]


def sha(text):
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


# ---- hard negatives


def plain_mine(vectors, is_anchor, k=5, m=10, low=(3, 10), high=(9, 10)):
    live = []
    for i, label, v in vectors:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            live.append((i, label, [math.floor(256 * x) for x in v]))
    out = []
    for i, label, v in live:
        if not is_anchor(i):
            continue
        near = [(-sum(a * b for a, b in zip(v, w)), j, other) for j, other, w in live if j != i and len(w) == len(v)]
        near = [x for x in near if abs(x[0]) < 1 << 59]
        for p, j, _ in sorted(x for x in near if x[2] == label)[:k]:
            hard = sorted((s, n) for s, n, other in near if other != label and low[0] * -p <= low[1] * -s and high[1] * -s <= high[0] * -p)
            out += [(i, j, r, n, -p, -s) for r, (s, n) in enumerate(hard[:m], 1)]
    return Counter(out)


def test_mining_equals_the_plain_version(spark):
    rng = random.Random(3)
    centre = [[rng.gauss(0, 0.3) for _ in range(8)] for _ in range(4)]
    vectors = [(i, i % 4 if i % 9 else (i + 1) % 4, [x + rng.gauss(0, 0.2) for x in centre[i % 4]]) for i in range(300)]
    vectors += [(1000 + i, i % 2, [0.25] * 8) for i in range(60)]  # ties, more than are asked for
    vectors += [(20, 0, [0.5] * 8), (20, 0, [0.5] * 8), (21, 1, [0.5] * 8), (21, 1, [0.5] * 8)]  # ids and rows that repeat
    vectors += [(None, 1, [0.1] * 8), (40, None, [0.1] * 8), (41, 1, None), (42, 1, [None] + [0.1] * 7), (43, 1, [float("nan")] * 8), (44, 1, [float("inf")] * 8)]
    vectors += [(50, 1, [0.5, 0.5]), (51, 1, [0.5, 0.25]), (52, 2, [0.5, 0.1]), (60, 7, [0.3] * 8), (61, 3, []), (62, 3, []), (63, 1, [])]
    vectors += [(80, 5, [1e7] * 8), (81, 5, [2e7] * 8), (82, 6, [1e7] * 8), (100, 5, [3e8] * 8), (101, 5, [-0.5] * 8), (120, 8, [1e30] * 8), (121, 8, [1e30] * 8)]
    df = spark.createDataFrame(vectors, "vec_id long, label long, vector array<double>").withColumn("score", F.lit(1)).withColumn("packet", F.lit(1))
    want = plain_mine(vectors, lambda i: i % 20 == 0)
    assert len(want) > 500
    for parts in (1, 7):
        got = Counter(rows(hard_negatives.mine(df.repartition(parts), F.col("vec_id") % 20 == 0)))
        assert got == want


def test_mining_other_counts_and_fractions(spark):
    rng = random.Random(5)
    vectors = [(i, i % 3, [rng.uniform(-1, 1) for _ in range(4)]) for i in range(200)]
    df = spark.createDataFrame(vectors, "vec_id long, label long, vector array<float>")
    exact = [(i, label, [float(np.float32(x)) for x in v]) for i, label, v in vectors]
    got = hard_negatives.mine(df, F.col("vec_id") % 10 == 0, positives=2, negatives=3, low=(-1, 2), high=(11, 10))
    assert Counter(rows(got)) == plain_mine(exact, lambda i: i % 10 == 0, 2, 3, (-1, 2), (11, 10))


def test_mining_without_rows(spark):
    none = spark.createDataFrame([], "vec_id long, label long, vector array<float>")
    assert rows(hard_negatives.mine(none, F.col("vec_id") % 10 == 0)) == []
    alone = spark.createDataFrame([(10, 1, [0.5])], none.schema)
    assert rows(hard_negatives.mine(alone, F.col("vec_id") % 10 == 0)) == []


def test_chunks_send_no_more_buckets_than_are_asked_for(spark):
    """All rows of one label tie or spread over thousands of scores: either way a chunk sends few counts."""
    vectors = [(i, 1 + (i > 0), [i / 256 / 100, 1.0]) for i in range(2000)]
    df = spark.createDataFrame(vectors, "vec_id long, label long, v array<double>").select("vec_id", "label", F.transform("v", lambda x: x * 256).alias("v"))
    chunks = packets.packed(df.coalesce(1), hard_negatives._pack)
    windows = chunks.select("packet", F.lit(0).cast("long").alias("slot"), F.lit(0).cast("long").alias("w"), F.lit(0).cast("long").alias("lo"), F.lit(1 << 17).cast("long").alias("hi"), F.lit(0).alias("shift"), F.lit(10).alias("need"), F.lit(True).alias("open"))
    pairs = hard_negatives._joined(chunks, chunks, windows, 1)
    counted = rows(pairs.mapInArrow(hard_negatives._counts(False, pairs.columns), "packet long, slot long, w long, bucket long, n long"))
    assert sum(r[-1] for r in counted) >= 10 and len(counted) <= 10


# ---- alignment

TEXTS = [
    (1, "Hello  world, this is a test of tokenisation. "), (2, None), (3, ""), (4, "   "), (5, "naïve café 漢字 \U0001F600 x"), (5, "naïve café 漢字 \U0001F600 x"), (6, "a▁b is not the same"),
    (7, "<|endoftext|> <s> </s> <unk> <0x41>"), (None, "no id, it's we'll don't"), (8, "\ttabs\nand\r\nlines\n\n\n  end"), (9, "word " * 20000), (10, "x" * 4000), (11, "ﬁ é é  　 \x00 \x7f"), (12, "Hello world"), (13, " leading"), (14, "12345 67,890.12 $%&*"),
]


def plain_align(docs):
    tok = Tokenizer.from_file(A_PATH)
    tok.encode_special_tokens = True
    model = SentencePieceProcessor(model_file=B_PATH)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    linked = []
    for _, text in docs:
        groups = []
        if text:
            raw = (" " + text).encode()
            a = [(i, bytes(byte_of[c] for c in t)) for e in [tok.encode(" " + text, add_special_tokens=False)] for i, t in zip(e.ids, e.tokens)]
            pieces = [(i, model.id_to_piece(i)) for i in model.encode(text, num_threads=1)]
            b = [(i, bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode()) for i, p in pieces]
            if b"".join(x for _, x in a) == raw == b"".join(x for _, x in b):
                ends = [set(np.cumsum([len(x) for _, x in t]).tolist()) for t in (a, b)]
                for cut in sorted(ends[0] & ends[1]):
                    groups.append(([], []))
                for side, t in enumerate((a, b)):
                    at, k = 0, 0
                    for i, x in t:
                        groups[k][side].append(i)
                        at += len(x)
                        k += at in ends[0] & ends[1]
        linked.append(groups)
    held = Counter(pair for groups in linked for pair in {(x, y) for a, b in groups for x in a for y in b})
    most = defaultdict(int)
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    out = []
    for (i, _), groups in zip(docs, linked):
        links = [(x, y) for a, b in groups for x in a for y in b]
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        out.append((i, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links), sha(text) if groups else "", sum(held[p] == most[p[0]] for p in links), sum(held[p] for p in links)))
    return Counter(out)


def aligned(df):
    return Counter(rows(token_align.align_documents(df, A_PATH, public.PATTERN, B_PATH)))


def test_alignment_equals_the_plain_version(spark):
    df = spark.createDataFrame(TEXTS, "doc_id long, text string").withColumn("pair", F.lit("x")).withColumn("n", F.lit(1))
    want = plain_align(TEXTS)
    assert aligned(df.coalesce(1)) == want == aligned(df.repartition(5))


def test_alignment_on_the_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    assert aligned(docs.repartition(3)) == plain_align([tuple(r) for r in docs.collect()])


def test_alignment_with_a_small_cache(spark, monkeypatch):
    (cut, a), (cut_b, b) = token_align.byte_level(A_PATH, public.PATTERN), token_align.piece_model(B_PATH)
    texts = [x for _, x in TEXTS if x]
    for pieces, cutter in ((a, cut), (b, cut_b)):
        first = [pieces.tokens([cutter(" " + x)])[0].tolist() for x in texts]
        pieces.chars = token_align.CACHE + 1
        assert [pieces.tokens([cutter(" " + x)])[0].tolist() for x in texts] == first


def test_alignment_of_an_empty_table(spark):
    assert not aligned(spark.createDataFrame([], "doc_id long, text string"))


# ---- repeats


def plain_repeats(docs, window=50):
    words = [SPLIT.findall(t or "") for _, t in docs]
    least = {}
    for (i, _), w in zip(docs, words):
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            least[key] = min(least.get(key, math.inf), math.inf if i is None else i)
    out = []
    for (i, _), w in zip(docs, words):
        gone = set()
        for k in range(len(w) - window + 1):
            if least[tuple(w[k : k + window])] < (math.inf if i is None else i):
                gone |= set(range(k, k + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return Counter(out)


def found(df, window=50):
    gone = F.aggregate("repeats", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["first"])
    return Counter(rows(block_repeats.find_repeats(df, window).select("doc_id", "n_words", gone, "kept")))


def passages():
    rng = random.Random(11)
    own = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    shared = own(130)
    docs = [(1, None), (2, ""), (3, " \n"), (4, " ".join(own(49))), (5, " ".join(shared[:49]))]
    for i in range(6, 60):  # the passage at all places, whole and in parts
        a, b = rng.randrange(0, 80), rng.randrange(50, 130)
        docs.append((i, " ".join(own(rng.randrange(60)) + shared[a : max(b, a + 49)] + own(rng.randrange(60)))))
    docs += [(6, docs[5][1]), (60, " ".join(shared)), (61, "\t".join(shared)), (None, " ".join(shared)), (None, " ".join(shared + own(9))), (62, " ".join(shared + own(5) + shared))]
    docs += [(63, "one two " * 40), (64, "two one " * 60), (65, "z " * 50), (66, "z " * 49), (67, "é漢 " * 20000), (68, "é漢 " * 70), (-5, " ".join(shared[40:95]))]
    docs += [(70 + k, docs[20][1]) for k in range(40)]
    return docs


def test_repeats_equal_the_plain_version(spark):
    docs = passages()
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("kept", F.lit("x")).withColumn("body", F.lit(1))
    want = plain_repeats(docs)
    assert sum(n for (_, _, n, _), k in want.items()) > 1000
    assert found(df.coalesce(1)) == want == found(df.repartition(9))


@pytest.mark.parametrize("window", [2, 3, 7])
def test_repeats_of_other_lengths(spark, window):
    rng = random.Random(window)
    docs = [(rng.randrange(40), " ".join(rng.choice("abc") for _ in range(rng.randrange(30)))) for _ in range(80)]
    assert found(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), window) == plain_repeats(docs, window)


def test_removed_repeats_keep_other_texts_and_columns(spark):
    docs = passages()
    df = spark.createDataFrame([(i, t, None if t is None else len(t), k) for k, (i, t) in enumerate(docs)], "doc_id long, text string, n_chars long, _row int")
    got = {r["_row"]: r for r in block_repeats.remove_repeats(df.repartition(3)).collect()}
    assert len(got) == len(docs) and list(got[0].asDict()) == df.columns
    kept = defaultdict(list)
    for i, n, gone, text in plain_repeats(docs).elements():
        kept[i].append((gone, text))
    for k, (i, t) in enumerate(docs):
        text = got[k]["text"]
        assert text == t and (0, " ".join(SPLIT.findall(t or ""))) in kept[i] or text in [x for gone, x in kept[i] if gone]
        assert got[k]["n_chars"] == (None if text is None else len(text))


def test_repeats_of_an_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert not found(none) and rows(block_repeats.remove_repeats(none)) == []


def test_one_passage_in_all_documents_makes_no_pairs(spark):
    """What the packets send grows with the documents, not with their square."""
    shared = " ".join(f"s{k}" for k in range(80))
    sent = []
    for n in (200, 400):
        df = spark.createDataFrame([(i, f"{shared} own{i}") for i in range(n)], "doc_id long, text string").repartition(4)
        told = packets.packed(df.select("doc_id", "text"))
        sent.append(told.mapInArrow(lambda bs: (b.select([0]) for b in bs), "packet long").count())
        assert found(df) == Counter([(0, 81, 0, f"{shared} own0")] + [(i, 81, 80, f"own{i}") for i in range(1, n)])
    assert sent[0] == sent[1] == 4


def test_compact_lists():
    rng = np.random.default_rng(0)
    for kind in (np.uint32, np.uint64, np.int64):
        x = np.sort(rng.integers(0, 1 << 31, 999).astype(kind))
        assert (packets.grown(packets.shrunk(x), kind) == x).all()
    assert len(packets.grown(packets.shrunk(np.zeros(0, np.uint64)), np.uint64)) == 0
    f = rng.integers(0, 2, 77).astype(bool)
    assert (packets.flags(packets.bits(f), 77) == f).all()
