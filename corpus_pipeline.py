"""A training-data pipeline over ``documents``: five stages, each written as Parquet and reread.

Toxic documents go, then documents of bad quality, then all but one of each group of near
copies; benchmark passages are cut out of the rest, which is encoded at last. Each stage works
on all that the one before it kept and judges it by its own input.

Defined cases: a null, empty or wordless text is not toxic, and goes by the quality rules, which ask
for 50 words; very long texts count whole in every stage; a null id is judged like any other and
never labelled, and is the last of a group of copies to stay; rows of one id with different texts
are different documents, repeated rows are copies of one; documents labelled twice are toxic
if one label says so and good only if all do; without labels nothing is toxic and only the base
rules of quality reject, and without items of ``benchmark`` nothing is cut; an empty table passes
all stages as it is; columns beside those of ``documents``, of any name, are kept up to the last
stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnforge.llm import bpe_fold, fm_decontam, near_copies, quality_forest, weak_toxicity
from tarnforge.llm.common import ensure_checkpoint_dir, free_name, remove, table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the limit stay."""
    score = free_name(docs.columns, "_toxicity")
    scored = weak_toxicity.score_toxicity(docs, table(spark, sf_dir, "labels"), weak_toxicity.held_fold() != 1, docs.columns, score)
    return scored.where(F.col(score) < weak_toxicity.LIMIT).select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the isolation forest stay."""
    return quality_forest.keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of texts with four fifths of their five-word shingles in common stays."""
    return near_copies.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay, without the spans that lie in benchmark phrases."""
    return fm_decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids, n_tokens and the text decoded from the ids."""
    import public_tokenizers as public

    path = public.path("byte_bpe_multi_50k.tiktoken")
    bpe = bpe_fold.Bpe(bpe_fold.read_ranks(path))
    out = bpe_fold.encode_documents(docs.select("doc_id", "lang", "source", "text"), path, public.PATTERN, bpe)
    out = bpe.decoded(out, "ids", "decoded")
    return out.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), F.col("decoded").cast("string").alias("decoded"))


STAGES = [("toxicity", toxicity), ("quality rules", quality), ("near-dedup", near_dedup), ("decontamination", decontamination), ("encoding", encoding)]

#: A label model, an isolation forest and components of near copies are beyond SQL; the tests run a
#: brute-force version of each stage instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage wrote is removed when the next one has written its own."""
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            remove(spark, f"{folder}/{k - 1}")
    return docs
