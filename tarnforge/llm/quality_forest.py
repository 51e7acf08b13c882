"""Quality rules: an isolation forest on rule statistics.

Rule statistics of every whole text are computed once and checkpointed; everything after
reads that small table. The forest is fitted on a bounded sample (``SAMPLE``) of labelled
good rows: each tree isolates ``PER_TREE`` of them by random splits, and a short mean path
marks a document unlike them. A split is drawn from the span of the node's rows widened by
``MARGIN`` spans on both sides, so that many splits lie where no sampled row is and cut off
what lies beyond; splits within the span alone would hold a document far outside for as
usual as the outermost sampled one. The threshold is calibrated on all labelled rows: of the
score bins that lose at most ``MAX_LOSS`` of the good rows, the one that rejects most bad
rows. Without usable labels nothing but the base rules rejects.

Defined cases: a null text has no words; texts of any length are counted whole; a null id is
judged like any other and never labelled; repeated rows stay repeated; a document with
several labels counts as good only if all say so; an empty table gives no rows; rows
labelled null are unlabelled; other columns, of any name, are ignored by ``judge_quality`` and
kept by ``keep_good``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnforge.llm.common import cut, small_batches, table

SAMPLE, TREES, PER_TREE, MARGIN, DEEPEST, MAX_LOSS, BINS, SEED = 4096, 128, 256, 4.0, 64, 0.002, 4000, 11
#: Labelled ids that are broadcast at most; beyond, ``keep_good`` reads the statistics of all documents.
FEW = 1 << 20
SYMBOLS = b"#*$%&|<>"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_lines", "n_distinct", "n_upper", "n_other", "n_digits", "n_twice"]
_ROWS = 2048
_UPPER = bytes(i for i in range(65, 91))
_DIGIT = bytes(range(48, 58))
_OTHER = bytes(i for i in range(33, 127) if not chr(i).isalnum() and i not in b".,")
_SPACE = b" \t\n\x0b\x0c\r"


def repeated_words(ids: np.ndarray) -> int:
    """How many words lie in a window of three words that the text holds twice or more. Exact."""
    n = len(ids) - 2
    if n < 2:
        return 0
    pair = np.unique(ids[:-1] * (int(ids.max()) + 1) + ids[1:], return_inverse=True)[1]
    triple = pair[:-1] * (int(ids.max()) + 1) + ids[2:]
    _, at, times = np.unique(triple, return_inverse=True, return_counts=True)
    hit = times[at] > 1
    cover = np.zeros(n + 2, dtype=bool)
    for k in range(3):
        cover[k : n + k] |= hit
    return int(cover.sum())


def statistics(text: str | None) -> list[int]:
    """BASE and MORE of one whole text."""
    b = (text or "").encode("utf-8", "surrogatepass")
    words = b.split()  # at \x20 and \x09-\x0D
    n = len(words)
    if not n:
        return [0] * (len(BASE) + len(MORE))
    without = lambda kinds: len(b) - len(b.translate(None, kinds))
    lines, seen, dup, real = b.split(b"\n"), set(), 0, 0
    for x in lines:
        if x.strip(_SPACE):
            real += 1
            if x in seen:
                dup += 1
            seen.add(x)
    place: dict[bytes, int] = {}
    ids = np.fromiter((place.setdefault(w, len(place)) for w in words), dtype=np.int64, count=n)
    chars = len(text) - without(_SPACE)
    return [
        n, chars, without(SYMBOLS), dup, repeated_words(ids),
        real, len(place), without(_UPPER), without(_OTHER), without(_DIGIT), int((ids[1:] == ids[:-1]).sum()),
    ]


def document_statistics(docs: DataFrame) -> DataFrame:
    """``(doc_id, text)`` to doc_id and the statistics, in one pass."""
    small_batches(docs.sparkSession)
    names = BASE + MORE

    def run(batches):
        for b in batches:
            rows = np.array([statistics(x.as_py()) for x in b.column(1)], dtype=np.int64).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, rows.T)], ["doc_id", *names])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{c} long" for c in names))


def base_failed() -> F.Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def features(x: np.ndarray) -> np.ndarray:
    """Rates by word or character, so that length alone is no anomaly. ``x``: BASE and MORE."""
    x = x.astype(float)
    words, chars, lines = np.maximum(x[:, 0], 1), np.maximum(x[:, 1], 1), np.maximum(x[:, 5], 1)
    return np.column_stack([
        x[:, 1] / words, x[:, 2] / words, x[:, 3] / lines, x[:, 4] / words, np.minimum(words / lines, 200),
        x[:, 7] / chars, x[:, 8] / words, x[:, 9] / chars, x[:, 10] / words,
    ])


def fit_forest(x: np.ndarray, seed: int = SEED) -> dict:
    """Trees as arrays: ``feature`` (-1: a leaf), ``split``, ``left``, ``right``, ``depth``."""
    rng, nodes, roots = np.random.default_rng(seed), [], []
    size = min(PER_TREE, len(x))

    def grow(rows: np.ndarray, depth: int) -> int:
        at = len(nodes)
        nodes.append([-1, 0.0, 0, 0, depth + _mean_path(len(rows))])
        low, high = rows.min(axis=0), rows.max(axis=0)
        open_ = np.flatnonzero(high > low)
        if len(rows) > 1 and depth < DEEPEST and len(open_):
            f = int(rng.choice(open_))
            beyond = MARGIN * (high[f] - low[f])
            v = rng.uniform(low[f] - beyond, high[f] + beyond)
            go = rows[:, f] < v
            nodes[at][:2] = [f, v]
            nodes[at][2] = grow(rows[go], depth + 1) if go.any() else _leaf(nodes, depth + 1)
            nodes[at][3] = grow(rows[~go], depth + 1) if (~go).any() else _leaf(nodes, depth + 1)
        return at

    for _ in range(TREES):
        roots.append(grow(x[rng.choice(len(x), size, replace=False)], 0))
    a = np.array(nodes, dtype=float)
    # Of the splits of a widened span, one in 1 + 2 * MARGIN parts rows; paths are that much longer.
    return {"roots": np.array(roots), "feature": a[:, 0].astype(int), "split": a[:, 1], "left": a[:, 2].astype(int), "right": a[:, 3].astype(int), "depth": a[:, 4], "norm": _mean_path(size) * (1 + 2 * MARGIN)}


def _leaf(nodes: list, depth: int) -> int:
    nodes.append([-1, 0.0, 0, 0, float(depth)])
    return len(nodes) - 1


def _mean_path(n: int) -> float:
    """Mean path of an unsuccessful search in a tree of n points."""
    return 0.0 if n < 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def score_forest(forest: dict, x: np.ndarray) -> np.ndarray:
    """Anomaly, 0 to 1, from the mean path length. All trees at once, some rows at a time."""
    trees = len(forest["roots"])
    out = np.zeros(len(x))
    for k in range(0, len(x), _ROWS):
        part = x[k : k + _ROWS]
        at, live = np.tile(forest["roots"], len(part)), np.arange(len(part) * trees)
        while len(live):
            node = at[live]
            f = forest["feature"][node]
            inner = f >= 0
            live, node, f = live[inner], node[inner], f[inner]
            at[live] = np.where(part[live // trees, f] < forest["split"][node], forest["left"][node], forest["right"][node])
        out[k : k + _ROWS] = forest["depth"][at].reshape(len(part), trees).mean(axis=1)
    return 2.0 ** (-out / max(forest["norm"], 1e-9))


def labelled(labels: DataFrame) -> DataFrame:
    """doc_id and quality: 1 where all labels of an id are."""
    return labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))


def fit_quality(stats: DataFrame, labels: DataFrame) -> tuple[dict, float] | None:
    """Forest and limit from the statistics of all documents and the labels; None without good rows."""
    good = labelled(labels)
    sample = stats.join(good.where("quality = 1"), "doc_id", "left_semi").where(~base_failed())
    rows = sample.orderBy(F.xxhash64("doc_id"), *BASE, *MORE).limit(SAMPLE).select(*BASE, *MORE).collect()
    if len(rows) < 2:
        return None
    forest = fit_forest(features(np.array(rows)))
    scored = with_anomaly(stats.where(~base_failed()).join(good, "doc_id"), forest)
    bins = scored.groupBy(F.floor(F.col("anomaly") * BINS).alias("bin"), (F.col("quality") == 1).alias("good")).count().collect()
    return forest, calibrate([(r["bin"], r["good"], r["count"]) for r in bins])


def with_anomaly(stats: DataFrame, forest: dict) -> DataFrame:
    shared = stats.sparkSession.sparkContext.broadcast(forest)
    names = stats.columns
    at = [names.index(c) for c in BASE + MORE]

    def run(batches):
        for b in batches:
            x = np.column_stack([b.column(i).to_numpy(zero_copy_only=False) for i in at])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score_forest(shared.value, features(x)), pa.float64())], [*names, "anomaly"])

    return stats.mapInArrow(run, T.StructType([*stats.schema.fields, T.StructField("anomaly", T.DoubleType())]))


def judge_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, BASE, base_failed, anomaly (null without labels), kept."""
    stats = cut(document_statistics(docs))
    fitted = fit_quality(stats, labels)
    if fitted is None:
        return stats.select("doc_id", *BASE, base_failed().alias("base_failed"), F.lit(None).cast("double").alias("anomaly"), (~base_failed()).alias("kept"))
    forest, limit = fitted
    return with_anomaly(stats, forest).select("doc_id", *BASE, base_failed().alias("base_failed"), "anomaly", (~base_failed() & (F.col("anomaly") < limit)).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that neither a base rule nor the forest rejects, with all columns. The verdict is
    made where the text is, so that no text is shuffled; of the fit, only the statistics of labelled
    documents are needed."""
    ids = cut(labelled(labels).select("doc_id"))
    known = docs.select("doc_id", "text")
    if ids.count() <= FEW:
        known = known.join(F.broadcast(ids), "doc_id", "left_semi")
    fitted = fit_quality(cut(document_statistics(known)), labels)
    shared = docs.sparkSession.sparkContext.broadcast(fitted)
    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            x = np.array([statistics(t.as_py()) for t in b.column(at)], dtype=np.int64).reshape(-1, len(BASE) + len(MORE))
            good = (x[:, 0] >= 50) & (100 * x[:, 4] <= 50 * x[:, 0])
            if shared.value is not None:
                forest, limit = shared.value
                good &= score_forest(forest, features(x)) < limit
            yield b.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)


def calibrate(bins: list[tuple[int, bool, int]]) -> float:
    """The lowest score that is rejected: half way from the best bin to the next labelled one below."""
    good = sum(n for _, g, n in bins if g)
    by: dict[int, list[int]] = {}
    for b, g, n in bins:
        by.setdefault(b, [0, 0])[g] += n
    order = sorted(by, reverse=True)
    lost = bad = 0
    best, limit = 0, 2.0
    for i, k in enumerate(order):
        bad, lost = bad + by[k][0], lost + by[k][1]
        if lost > MAX_LOSS * good:
            break
        if bad - lost > best:
            below = order[i + 1] + 1 if i + 1 < len(order) else k
            best, limit = bad - lost, (k + below) / 2 / BINS
    return limit


def op4_quality_forest(spark, sf_dir: str) -> DataFrame:
    return judge_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
