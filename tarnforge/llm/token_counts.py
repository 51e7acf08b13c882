"""Token counts: a two-tier lookup on the map side, with no shuffle of pre-tokens.

First tier: a broadcast table of the lengths of frequent pre-tokens, of at most ``FREQUENT``
entries of at most ``LONGEST`` characters each. Its candidates are the most frequent pre-tokens of
a bounded random sample of about ``SAMPLE`` documents, counted where they lie and added up on the
driver, which gets at most ``PER_TASK`` of each task's; the table decides speed only, never a
count. Second tier: pre-tokens that the table lacks are encoded by the tokenizer itself, each
once, and kept in a cache of the worker of at most ``CACHE`` entries of at most ``LONGEST``
characters; longer ones are encoded each time.

Byte-level BPE never merges across pre-tokens, so the counts of the pre-tokens add up to
the text's. Strings of added special tokens are cut out first and count as one token each,
as the library does by default.

Defined cases: a null text counts as empty (no tokens); whole texts are encoded whatever
their length; a null id is kept; repeated rows stay repeated; an empty table gives no rows; other
columns, of any name, are ignored.
"""

from __future__ import annotations

import json
import os
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnforge.llm.common import small_batches, table

SAMPLE, FREQUENT, PER_TASK, LONGEST, CACHE, SEED = 4096, 1 << 18, 1 << 16, 64, 1 << 18, 9
_loaded: dict = {}


def _tools(path: str, pattern: str):
    """Tokenizer, pre-token pattern and pattern of special strings, once a worker."""
    if (path, pattern) not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            added = [t["content"] for t in json.load(f).get("added_tokens", [])]
        special = regex.compile("|".join(map(regex.escape, sorted(added, key=len, reverse=True)))) if added else None
        _loaded[path, pattern] = Tokenizer.from_file(path), regex.compile(pattern), special, {}
    return _loaded[path, pattern]


def _pieces(text: str, words, special) -> tuple[list[str], int]:
    """Pre-tokens of a text and the number of special strings in it."""
    if special is None or special.search(text) is None:
        return words.findall(text), 0
    parts = special.split(text)
    return [w for p in parts for w in words.findall(p)], len(parts) - 1


def frequent_lengths(docs: DataFrame, path: str, pattern: str) -> dict[str, int]:
    """The first tier: pre-token to token count, of bounded size. Rows are drawn one by one, so that
    neither a hot id nor a hot text makes the sample larger."""
    import pyarrow as pa

    def count(batches):
        _, words, special, _ = _tools(path, pattern)
        seen: Counter = Counter()
        for b in batches:
            for x in b.column(0):
                seen.update(w for w in _pieces(x.as_py() or "", words, special)[0] if len(w) <= LONGEST)
                if len(seen) > 8 * PER_TASK:
                    seen = Counter(dict(seen.most_common(2 * PER_TASK)))
        top = seen.most_common(PER_TASK)
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["w", "n"])

    rows = docs.count()
    drawn = docs.select("text").where(F.rand(SEED) < min(1.0, SAMPLE / max(rows, 1)))
    total: Counter = Counter()
    for b in drawn.mapInArrow(count, "w string, n long").toArrow().to_batches():
        total.update(dict(zip(b.column(0).to_pylist(), b.column(1).to_pylist())))
    top = [w for w, _ in total.most_common(FREQUENT)]
    tok = _tools(path, pattern)[0]
    return {w: len(e.ids) for w, e in zip(top, tok.encode_batch_fast(top, add_special_tokens=False))}


def count_tokens(docs: DataFrame, path: str, pattern: str, limit: int = 512) -> DataFrame:
    """``(doc_id, text)`` to doc_id, n_bytes, n_tokens, over_limit."""
    import pyarrow as pa

    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, path, pattern))

    def encode(batches):
        tok, words, special, cache = _tools(path, pattern)
        lengths = shared.value
        for b in batches:
            sizes, counts, misses, rows = [], [], [], []
            for x in b.column(1):
                text = x.as_py() or ""
                pieces, n = _pieces(text, words, special)
                sizes.append(len(text) if text.isascii() else len(text.encode()))
                got = list(map(lengths.get, pieces))
                if None in got:
                    own = [w for w, k in zip(pieces, got) if k is None]
                    rows.append((len(counts), own))
                    misses.extend(w for w in own if w not in cache)
                    n += sum(k for k in got if k is not None)
                else:
                    n += sum(got)
                counts.append(n)
            if rows:
                if len(cache) > CACHE:
                    cache.clear()
                    misses = [w for _, own in rows for w in own]
                new = list(dict.fromkeys(misses))
                here = dict(zip(new, (len(e.ids) for e in tok.encode_batch_fast(new, add_special_tokens=False))))
                cache.update((w, n) for w, n in here.items() if len(w) <= LONGEST)
                for i, own in rows:
                    counts[i] += sum(here[w] if w in here else cache[w] for w in own)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])
        cache.clear()  # an idle worker holds no words

    return docs.select("doc_id", "text").mapInArrow(encode, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")


def op10_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers as public

    return count_tokens(table(spark, sf_dir, "documents"), public.path("byte_bpe_50k.json"), public.PATTERN)
