"""Languages whose rows are copies, and benchmark windows that many items share."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tarnforge.llm import fm_decontam, language_id


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("copies", [1, 2, 20_000])
def test_a_language_of_copies_of_one_text_is_learnt(spark, copies):
    rng = random.Random(1)
    words = {"en": "the of and with house river stone garden".split(), "fr": "le la et avec maison fleuve pierre jardin".split()}
    rows = [(i, " ".join(rng.choice(words[lang]) for _ in range(12)), lang) for i, lang in enumerate(["en", "fr"] * 150)]
    one = "zwyx qvkz wxyzz kqwv zzyx vwkq"
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    docs = docs.unionByName(spark.range(10_000, 10_000 + copies).select(F.col("id").alias("doc_id"), F.lit(one).alias("text"), F.lit("zz").alias("lang")))
    docs = docs.unionByName(spark.createDataFrame([(5000, "12 !", "no"), (5001, None, "none")], docs.schema))
    for parts in (1, 6):
        sample = language_id.training_sample(docs.repartition(parts), "lang")
        assert sorted({r[2] for r in sample}) == ["en", "fr", "zz"] and sum(r[2] == "zz" for r in sample) == 1
    got = language_id.identify(docs, F.col("doc_id") >= 0)
    assert {r.lang_pred for r in got.where("doc_id >= 10000").select("lang_pred").distinct().collect()} == {"zz"}
    right = got.join(docs.select("doc_id", "lang"), "doc_id").where("doc_id < 300").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.98


def test_a_sample_has_so_many_texts_a_language(spark, monkeypatch):
    monkeypatch.setattr(language_id, "PER_LANGUAGE", 7)
    docs = spark.range(400).select(F.concat(F.lit("text "), F.col("id") % 100, F.lit(" x")).alias("text"), F.when(F.col("id") % 100 < 5, "few").otherwise("many").alias("lang"))
    langs = [r[2] for r in language_id.training_sample(docs, "lang")]
    assert langs.count("few") == 5 and langs.count("many") == 7
    monkeypatch.setattr(language_id, "MOST", 1)
    assert sorted(r[2] for r in language_id.training_sample(docs, "lang")) == ["few", "many"]


TEMPLATE = "answer the following question with one of the choices given below now".split()


def shared(n_items, n_docs):
    items = [(k, " ".join([*TEMPLATE, f"item{k}", "what", "is", f"x{k}"])) for k in range(n_items)]
    docs = [(k, " ".join([f"own{k}", *TEMPLATE, f"other{k}"])) for k in range(n_docs)]
    docs += [(n_docs, items[3][1]), (n_docs + 1, "nothing here"), (n_docs + 2, None), (n_docs + 3, " ".join(TEMPLATE[:9]))]
    return items, docs


def plain(items, docs):
    windows = {}
    for i, t in items:
        w = t.split()
        for k in range(len(w) - 9):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(str(i))
    out = []
    for i, t in docs:
        w, hit, names = (t or "").split(), set(), set()
        for k in range(len(w) - 9):
            if tuple(w[k : k + 10]) in windows:
                hit |= set(range(k, k + 10))
                names |= windows[tuple(w[k : k + 10])]
        out.append((i, len(w), len(hit), len(names), sha(",".join(sorted(names)))))
    return sorted(out)


@pytest.mark.parametrize("block", [1_000_000, 50])
def test_a_window_of_all_items(spark, monkeypatch, block):
    monkeypatch.setattr(fm_decontam, "BLOCK_WORDS", block)
    items, docs = shared(60, 40)
    b, d = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    found = fm_decontam.find_contamination(d.repartition(3), b.repartition(2)).cache()
    got = sorted((r.doc_id, r.n_words, len(r.hits), r.n_items, r.item_set) for r in found.collect())
    assert got == plain(items, docs)
    sets = {r.item_set: list(r["items"]) for r in fm_decontam.item_sets(found).collect()}
    assert all(sha(",".join(x)) == k for k, x in sets.items()) and {r[4] for r in got} == set(sets) and len(sets) == 2


def test_work_is_of_different_windows_and_of_documents(monkeypatch):
    """Patterns searched, occurrences located and names made grow with items and with documents, not with their product."""
    counts = {}
    locate = fm_decontam.FMIndex.locate

    def counted(self, low, high):
        counts["located"] = counts.get("located", 0) + int((high - low).sum())
        return locate(self, low, high)

    monkeypatch.setattr(fm_decontam.FMIndex, "locate", counted)
    items, docs = shared(2000, 500)
    p = fm_decontam.Phrases([(str(i), t.encode().split()) for i, t in items])
    assert sum(len(w) for _, w, _ in p.patterns()) == 3 + 2000 * 4 and len(p.lists) == 2001
    hits, names = fm_decontam.search_blocks([fm_decontam.words_of(t) for _, t in docs], lambda: iter([p]))
    assert counts["located"] <= 3 * 501 + 10
    assert len({id(x) for x in names}) <= 3 and len(names[0]) == 2000 and [len(h) for h in hits[:2]] == [12, 12]
