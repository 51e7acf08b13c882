"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Text is lower-cased; all that is no letter is one boundary character. N-grams of 1 to
``MOST_N`` characters are hashed to 2**``BITS`` features. Document frequencies are counted over all
labelled training documents. The regression is fitted on a bounded sample of them (of each language the ``PER_LANGUAGE``
different texts with letters of the smallest hashes, fewer where that would make more than ``MOST`` in all, never none) by
follow-the-regularised-leader with a rate for each coordinate and an elastic-net penalty, whose L1
part keeps the weights sparse. A part of the sample that is not fitted calibrates one
temperature. Every whole text is then scored. The sample is chosen and ordered by hashes of the
texts, so that the model does not depend on files, partitions or ids.

Defined cases: a null id is never held out nor learnt from; a text that is null or has no letter is
``und`` with score 0, as are all texts when no training row has a language; a single language is
predicted with score 1; ties go to the first language in sorted order; very long texts are counted
whole, in pieces; repeated rows stay repeated, and count once in the sample; an empty table gives
no rows; other columns, of any name, are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnforge.llm.common import cut, id_crc, small_batches, table

BITS, MOST_N, PER_LANGUAGE, MOST, EPOCHS, SEED = 15, 3, 1000, 16_000, 4, 5
ALPHA, BETA, L1, L2 = 0.5, 1.0, 2e-3, 1e-3
CHUNK = 1 << 20
_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """Which code points are letters, once a process."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)
    return _letters


def codes(text: str | None) -> np.ndarray:
    """Lower-cased letters as numbers, runs of anything else as one 0, and 0 at both ends."""
    c = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    c = np.where(letters()[c], c, 0).astype(np.uint32)
    if not c.any():
        return c[:0]
    keep = (c > 0) | np.concatenate([[True], c[:-1] > 0])
    c = c[keep]
    return np.concatenate([[0] if c[0] else [], c, [0] if c[-1] else []]).astype(np.uint32)


def gram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Features of a whole text and their counts."""
    c = codes(text)
    if not len(c):
        return np.zeros(0, dtype=np.int64), np.zeros(0)
    total = np.zeros(1 << BITS, dtype=np.int64)
    for a in range(0, len(c), CHUNK):
        part = c[a : a + CHUNK + MOST_N - 1]
        h, grams = np.zeros(len(part), dtype=np.uint32), []
        for n in range(1, MOST_N + 1):
            h = (h[: len(part) - n + 1] * np.uint32(0x9E3779B1)) ^ (part[n - 1 :] * np.uint32(0x85EBCA6B) + np.uint32(n))
            grams.append(h[:CHUNK])
        own = np.concatenate(grams)
        own = (own ^ (own >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        total += np.bincount(own >> np.uint32(32 - BITS), minlength=1 << BITS)
    at = np.flatnonzero(total)
    return at, total[at].astype(float)


def tf_idf(at: np.ndarray, count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = count * idf[at]
    return x / max(float(np.sqrt(x @ x)), 1e-12)


def document_frequencies(docs: DataFrame) -> tuple[int, np.ndarray]:
    """Number of documents and, by feature, of those that have it; over all of ``docs``."""
    def count(batches):
        df, n = np.zeros(1 << BITS, dtype=np.int64), 0
        for b in batches:
            for x in b.column(0):
                at, _ = gram_counts(x.as_py())
                df[at] += 1
                n += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], n))], ["f", "n"])

    out = np.zeros((1 << BITS) + 1, dtype=np.int64)
    for r in docs.select("text").mapInArrow(count, "f long, n long").groupBy("f").agg(F.sum("n").alias("n")).collect():
        out[r["f"]] = r["n"]
    return int(out[-1]), out[:-1]


class Ftrl:
    """Follow-the-regularised-leader for a softmax over classes, by coordinate."""

    def __init__(self, features: int, classes: int):
        self.z, self.n = np.zeros((features, classes)), np.zeros((features, classes))

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def update(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        w = self.weights(at)
        p = softmax(x @ w)
        p[y] -= 1
        g = x[:, None] * p
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / ALPHA
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, by golden-section search over its logarithm."""
    loss = lambda t: -np.log(softmax(logits / np.exp(t))[np.arange(len(y)), y] + 1e-12).mean()
    low, high, g = np.log(0.02), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(60):
        a, b = high - g * (high - low), low + g * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def train(rows: list[tuple[np.ndarray, np.ndarray, str]], idf: np.ndarray) -> dict | None:
    """``rows``: features, counts and language of the sampled documents."""
    rows = [r for r in rows if len(r[0])]
    names = sorted({r[2] for r in rows})
    if not names:
        return None
    place = {n: i for i, n in enumerate(names)}
    rng = np.random.default_rng(SEED)
    data = [(at, tf_idf(at, c, idf), place[lang]) for at, c, lang in rows]
    order = rng.permutation(len(data))
    held, left = set(), Counter(y for _, _, y in data)
    for i in order[: len(data) // 5].tolist() if len(data) >= 20 else []:
        if left[data[i][2]] > 1:  # one text of each language is fitted
            held.add(i)
            left[data[i][2]] -= 1
    model = Ftrl(1 << BITS, len(names))
    for _ in range(EPOCHS):
        for i in rng.permutation(len(data)).tolist():
            if i not in held:
                model.update(*data[i])
    w = model.weights(slice(None))
    heat = 1.0
    if held and len(names) > 1:
        heat = temperature(np.array([data[i][1] @ w[data[i][0]] for i in sorted(held)]), np.array([data[i][2] for i in sorted(held)]))
    return {"names": names, "weights": (w / heat).astype(np.float32), "temperature": heat}


def training_sample(docs: DataFrame, lang: str) -> list[tuple[np.ndarray, np.ndarray, str]]:
    """Features of a bounded sample of each language: the different texts of the smallest hashes. Texts are made
    different before they are drawn, so that a language of copies of one text is learnt from that text."""
    key = F.xxhash64("text", F.lit(3))
    lettered = docs.where(F.col("text").rlike(r"\p{L}"))
    texts = cut(lettered.select(F.col(lang).alias("lang"), key.alias("key")).distinct())
    languages = texts.select("lang").distinct().count()
    if not languages:
        return []
    each = min(PER_LANGUAGE, max(1, MOST // languages))
    drawn = texts.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("key"))).where(F.col("place") <= each).select("lang", "key")
    # Of at most MOST rows, or one a language.
    chosen = lettered.select(F.col(lang).alias("lang"), key.alias("key"), "text").join(F.broadcast(drawn), ["lang", "key"], "left_semi").groupBy("lang", "key").agg(F.first("text").alias("text"))

    def run(batches):
        for b in batches:
            grams = [gram_counts(x.as_py()) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([a.astype("<u2" if BITS <= 16 else "<u4").tobytes() for a, _ in grams], pa.binary()), pa.array([c.astype("<u4").tobytes() for _, c in grams], pa.binary())], ["lang", "key", "at", "count"])

    found = chosen.mapInArrow(run, "lang string, key long, at binary, count binary").collect()
    return [(np.frombuffer(r["at"], "<u2" if BITS <= 16 else "<u4").astype(np.int64), np.frombuffer(r["count"], "<u4").astype(float), r["lang"]) for r in sorted(found, key=lambda r: (r["key"], r["lang"]))]


def identify(docs: DataFrame, trained: Column, lang: str = "lang") -> DataFrame:
    """``(doc_id, text)`` to doc_id, lang_pred, score. Learns from the rows that ``trained`` selects."""
    spark = docs.sparkSession
    small_batches(spark)
    known = docs.where(trained & F.col(lang).isNotNull())
    n, df = document_frequencies(known)
    idf = np.log((1 + n) / (1 + df)) + 1
    shared = spark.sparkContext.broadcast((train(training_sample(known, lang), idf), idf))

    def run(batches):
        model, idf = shared.value
        for b in batches:
            names, scores = [], []
            for x in b.column(1):
                at, count = gram_counts(x.as_py())
                if model is None or not len(at):
                    names.append("und")
                    scores.append(0.0)
                    continue
                p = softmax(tf_idf(at, count, idf) @ model["weights"][at].astype(float))
                k = int(p.argmax())
                names.append(model["names"][k])
                scores.append(float(p[k]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    fold = F.pmod(id_crc(F.col("doc_id")), F.lit(4))
    out = identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), fold != 2)
    return out.select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
