"""Toxicity by weak supervision: many lexicon and pattern voters, a generative label model, and a
linear classifier trained on its posterior labels.

1. A bounded sample of training rows (``MOST`` of each class, copies taken once) gives word and
   word-beginning features that occur almost only in toxic texts. Those that between
   them cover each toxic text several times become voters: a word is a lexicon voter, a word
   beginning a pattern voter. They say "toxic" or nothing; one more voter says "clean"
   where no feature occurs.
2. The label model takes each text's true class as hidden. Expectation-maximisation over the
   votes alone estimates how often each voter speaks in either class, hence its accuracy, and the
   share of toxic texts; the labels give only where it starts. Voters that correlate given the class are
   no independent evidence: their excess correlations are estimated from the posteriors,
   and a vote counts by 1 / (1 + its correlations with the other votes on the row).
3. A logistic regression over all features is fitted to the posteriors and scores every text.

The sample is chosen by a hash of the ids, and equal texts of it count once, in the order of a hash of
the texts: the model does not depend on files or partitions.

Defined cases: a null id is never held out; a null, empty or wordless text is scored by the prior
alone; very long texts are read whole; of several labels of a document the largest counts; null
labels are none; without labels of both classes every score is 0; repeated rows stay repeated; an
empty table gives no rows; other columns, of any name, are ignored unless they are asked for.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnforge.llm.common import free_name, id_crc, small_batches, table

MOST, VOTERS, COVER, FEATURES = 2500, 96, 6, 200
STEMS = (4, 5, 6)
_WORD = re.compile(r"[^\W_]+")


def tokens(text: str | None) -> set[str]:
    """Distinct lower-cased words of a whole text."""
    return set(_WORD.findall((text or "").lower()))


def features_of(words: set[str]) -> set[tuple]:
    """Words (length 0 of beginning) and the beginnings of longer words."""
    out = {(0, w) for w in words}
    for n in STEMS:
        out |= {(n, w[:n]) for w in words if len(w) > n}
    return out


def sketch(text: str | None, size: int = 3, n: int = 4) -> list[int]:
    """Minima of ``n`` hashes over the word shingles of a whole text: near copies share some."""
    import xxhash

    words = _WORD.findall((text or "").lower())
    shingles = {" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}
    h = np.fromiter((xxhash.xxh64_intdigest(x.encode()) for x in shingles), dtype=np.uint64, count=len(shingles))
    return [int((h * np.uint64(2 * k + 1) ^ np.uint64(0x9E3779B97F4A7C15 * k % 2**64)).min() >> np.uint64(1)) for k in range(n)]


def distinct_texts(sample: list[tuple[str, int, float, list[int]]]) -> list[tuple[str, int, float]]:
    """One of each group of copies, near ones included. Else the words of a text copied many times
    would look typical of its class."""
    seen, out = set(), []
    for words, y, weight, marks in sample:
        keys = {(y, k, m) for k, m in enumerate(marks)}
        if not keys & seen:
            out.append((words, y, weight))
        seen |= keys
    return out


def induce(sample: list[tuple[str, int]], each: tuple[float, float]) -> tuple[list[tuple], list[tuple], list[float]]:
    """Features typical of toxic texts, the voters among them and how often these are right on the
    corpus, from the weights of ``each`` clean and toxic row. ``sample``: words, label. Clean texts are only asked for the features that enough
    toxic ones have, so that few features are held at a time."""
    n1, n0 = sum(y for _, y in sample), sum(1 - y for _, y in sample)
    in1, in0 = Counter(), Counter()
    for words, y in sample:
        if y:
            in1.update(features_of(set(words.split())))
    need = max(4, n1 // 100)
    # By distinct words, not by texts: a long text holds many words that are rare elsewhere.
    size = [sum(len(words.split()) for words, y in sample if y == k) for k in (0, 1)]
    asked = {f for f, c in in1.items() if c >= need and c / size[1] > 20 * 0.5 / size[0]}
    in1 = Counter({f: in1[f] for f in asked})
    texts = []
    for words, y in sample:
        found = features_of(set(words.split())) & asked
        if y:
            texts.append(found)
        else:
            in0.update(found)
    good = [f for f in asked if in1[f] / size[1] > max(20 * (in0[f] + 0.5), 500 * in0[f]) / size[0]]
    holds = {f: [i for i, t in enumerate(texts) if f in t] for f in good}
    # Of a beginning and its extension that occurs nearly as often, the extension is the feature.
    best: Counter = Counter()
    for f in good:
        for n in STEMS:
            if len(f[1]) > n or (f[0] == 0 and len(f[1]) >= n):
                best[n, f[1][:n]] = max(best[n, f[1][:n]], in1[f])
    good = [f for f in good if f[0] == 0 or best[f] < 0.95 * in1[f]]
    features = sorted(good, key=lambda f: (-in1[f], f))[:FEATURES]
    short, voters, left = np.full(n1, COVER), [], {f: np.array(holds[f]) for f in features}
    while left and len(voters) < VOTERS:
        gain, best = max((int((short[at] > 0).sum()), f) for f, at in left.items())
        if gain == 0:
            break
        voters.append(best)
        short[left.pop(best)] -= 1
    return features, voters, [in1[v] * each[1] / (in1[v] * each[1] + (in0[v] + 0.5) * each[0]) for v in voters]


def label_model(votes: np.ndarray, toxic: np.ndarray, weight: np.ndarray, first: np.ndarray, rate: float, rounds: int = 100) -> tuple[np.ndarray, dict]:
    """Posterior of the hidden class by expectation-maximisation.

    ``votes``: rows by voters, 1 where a voter speaks; ``toxic``: for which class each voter
    speaks. A voter has a rate of speaking in either class, so that its voice and its silence
    are evidence; votes that correlate with others cast on the same row share their weight.
    ``first`` holds the accuracies (how often a voter that speaks is right) and ``rate`` the share of
    toxic rows before the first expectation; after it all rates come from the votes.
    """
    v = votes.astype(float)
    whole, spoke = weight.sum(), weight @ v
    for_toxic = np.where(toxic, first, 1 - np.asarray(first))
    prior, share, q = rate, np.zeros((v.shape[1],) * 2), None
    in_toxic, in_clean = for_toxic * spoke / (rate * whole), (1 - for_toxic) * spoke / ((1 - rate) * whole)
    for _ in range(rounds):
        a, b = np.clip(in_toxic, 1e-4, 1 - 1e-4), np.clip(in_clean, 1e-4, 1 - 1e-4)
        alone = v / (1 + v @ np.clip(share, 0, 1))
        z = np.log(prior / (1 - prior)) + alone @ np.log(a / b) + (1 - v) @ np.log((1 - a) / (1 - b))
        new = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        done = q is not None and np.abs(new - q).max() < 1e-7
        q = new
        if done:
            break
        p, n, one = weight * q, weight * (1 - q), weight.mean()  # of half a row more, voice and silence each
        prior = float(np.clip(p.sum() / whole, 1e-3, 1 - 1e-3))
        in_toxic, in_clean = (p @ v + one / 2) / (p.sum() + one), (n @ v + one / 2) / (n.sum() + one)
        share[:] = 0
        for w, own in ((p, toxic), (n, ~toxic)):  # excess correlations in the class they speak for
            m = w @ v / max(w.sum(), 1e-9)
            d = (v - m) / np.sqrt(np.maximum(m * (1 - m), 1e-6))
            share += (d * w[:, None]).T @ d / max(w.sum(), 1e-9) * np.outer(own, own)
        np.fill_diagonal(share, 0)
    right = prior * in_toxic / (prior * in_toxic + (1 - prior) * in_clean)
    return q, {"prior": prior, "accuracy": np.clip(np.where(toxic, right, 1 - right), 1e-4, 1 - 1e-4), "correlation": share}


def fit_linear(x: np.ndarray, q: np.ndarray, weight: np.ndarray, steps: int = 1500, ridge: float = 1e-5) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by accelerated projected gradient; weights stay
    non-negative, as each feature was chosen for speaking for toxicity."""
    x = np.column_stack([x, np.ones(len(x))]).astype(float)
    w = weight / weight.sum()
    u = np.ones(x.shape[1])
    for _ in range(30):  # the largest curvature, by power iteration
        u = x.T @ (w * (x @ u))
        u /= np.linalg.norm(u)
    rate = 4.0 / (float(u @ (x.T @ (w * (x @ u)))) * 1.05 + 4 * ridge)
    coef = np.zeros(x.shape[1])
    coef[-1] = -1.0
    last = coef.copy()
    for k in range(steps):
        y = coef + k / (k + 3) * (coef - last)
        g = x.T @ (w * (1 / (1 + np.exp(-np.clip(x @ y, -40, 40))) - q)) + ridge * y
        last = coef
        coef = y - rate * g
        coef[:-1] = np.maximum(coef[:-1], 0)
    return coef[:-1], float(coef[-1])


def train(sample: list[tuple[str, int, float, list[int]]]) -> dict | None:
    """``sample``: distinct words joined by blanks, label, weight, sketch."""
    sample = distinct_texts(sample)
    if len({y for _, y, _ in sample}) < 2:
        return None
    each = tuple(float(np.mean([w for _, y, w in sample if y == k])) for k in (0, 1))
    features, voters, precision = induce([(words, y) for words, y, _ in sample], each)
    if not voters:
        return None
    place = {f: i for i, f in enumerate(features)}
    x = np.zeros((len(sample), len(features)), dtype=np.float32)
    for i, (words, _, _) in enumerate(sample):
        for k in features_of(set(words.split())) & place.keys():
            x[i, place[k]] = 1
    weight = np.array([w for _, _, w in sample])
    speaks = x[:, [place[v] for v in voters]]
    none = x.sum(axis=1, keepdims=True) == 0  # one voter for the clean class: no feature occurs
    q, found = label_model(np.column_stack([speaks, none]), np.arange(len(voters) + 1) < len(voters), weight, np.array([*precision, 0.95]), float(weight @ np.array([y for _, y, _ in sample]) / weight.sum()))
    # The two posterior classes weigh alike, or the rare one hardly moves the fit; and texts with
    # few features weigh more, or the fit would count on several features in each text.
    high = q > 0.5
    weight = weight / np.maximum(x.sum(axis=1), 1) ** 2
    balance = weight * np.where(high, 0.5 / max(weight[high].sum(), 1e-9), 0.5 / max(weight[~high].sum(), 1e-9))
    # One row more for each voter: a text of which only that voter speaks, with its posterior.
    alone = np.zeros((len(voters), len(features)), dtype=np.float32)
    alone[np.arange(len(voters)), [place[v] for v in voters]] = 1
    single = found["accuracy"][: len(voters)]
    own = np.full(len(voters), 0.2 / max(len(voters), 1))
    coef, bias = fit_linear(np.vstack([x, alone]), np.concatenate([q, single]), np.concatenate([balance, own]))
    return {"coef": {f: float(c) for f, c in zip(features, coef) if c > 1e-6}, "bias": bias}


def score(model: dict, words: set[str], by: dict | None = None) -> float:
    by = by or by_length(model)
    z = model["bias"] + sum(map(by[0].get, words & by[0].keys()))
    for n in STEMS:
        if by[n]:
            z += sum(map(by[n].get, {w[:n] for w in words if len(w) > n} & by[n].keys()))
    return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def by_length(model: dict) -> dict[int, dict[str, float]]:
    return {n: {f[1]: c for f, c in model["coef"].items() if f[0] == n} for n in (0, *STEMS)}


def training_sample(docs: DataFrame, labels: DataFrame, trained: Column) -> list[tuple[str, int, float, list[int]]]:
    """Words, label, weight and sketch of about ``MOST`` labelled ids of each class, chosen by a hash of
    the id; equal texts count once. In the order of a hash of the texts."""
    y = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(trained).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = {r["toxic"]: r["count"] for r in y.where("toxic IN (0, 1)").groupBy("toxic").count().collect()}
    if len(n) < 2:
        return []
    share = {c: min(1.0, MOST / k) for c, k in n.items()}
    part = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 40)) / float(1 << 40)
    chosen = y.where("toxic IN (0, 1)").where(part < F.when(F.col("toxic") == 1, share[1]).otherwise(share[0]))
    key = F.xxhash64("text")
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy(key.alias("key"), F.col("toxic").cast("int").alias("toxic")).agg(F.first("text").alias("text"))

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([" ".join(sorted(tokens(x.as_py()))) for x in b.column(2)], pa.string()), b.column(1), pa.array([sketch(x.as_py()) for x in b.column(2)], pa.list_(pa.int64()))], ["key", "words", "toxic", "marks"])

    found = rows.mapInArrow(run, "key long, words string, toxic int, marks array<long>").collect()
    return [(r.words, r.toxic, 1 / share[r.toxic], r.marks) for r in sorted(found, key=lambda r: (r.key, r.toxic))]


def score_toxicity(docs: DataFrame, labels: DataFrame, trained: Column | None = None, keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """``keep`` (doc_id, if not given) and the score under ``name``. ``trained``: the label rows that may be learnt from."""
    spark = docs.sparkSession
    small_batches(spark)
    model = train(training_sample(docs, labels, F.lit(True) if trained is None else trained))
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        by = by_length(m) if m else None
        for b in batches:
            s = [score(m, tokens(x.as_py()), by) if m else 0.0 for x in b.column(0)]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(s, pa.float64())], [*keep, name])

    keep = keep or ["doc_id"]
    rows = docs.select(F.col("text").alias(free_name(keep, "_text")), *keep)
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[1:], T.StructField(name, T.DoubleType())]))


LIMIT = 0.7


def held_fold() -> Column:
    """Labels of remainder 1 are held out of training."""
    return F.pmod(id_crc(F.col("doc_id")), F.lit(3))


def op6_weak_toxicity(spark, sf_dir: str) -> DataFrame:
    fold = held_fold()
    out = score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold != 1)
    return out.select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= LIMIT).cast("int").alias("predicted"))
