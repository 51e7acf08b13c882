"""Queries and oracle SQL of the training-data operators."""

from __future__ import annotations

from tarnforge.llm import block_repeats, bpe_fold, chat_format, fm_decontam, golay_dedup, hard_negatives, hilbert_shards, language_id, quality_forest, token_align, token_counts, url_rules, weak_toxicity


def queries() -> dict:
    return {
        "op1_language_id": language_id.op1_language_id,
        "op2_hilbert_shards": hilbert_shards.op2_hilbert_shards,
        "op3_url_rules": url_rules.op3_url_rules,
        "op4_quality_forest": quality_forest.op4_quality_forest,
        "op5_fm_decontam": fm_decontam.op5_fm_decontam,
        "op6_weak_toxicity": weak_toxicity.op6_weak_toxicity,
        "op7_chat_format": chat_format.op7_chat_format,
        "op8_bpe_fold": bpe_fold.op8_bpe_fold,
        "op9_golay_dedup": golay_dedup.op9_golay_dedup,
        "op10_token_counts": token_counts.op10_token_counts,
        "op11_hard_negatives": hard_negatives.op11_hard_negatives,
        "op12_token_align": token_align.op12_token_align,
        "op13_block_repeats": block_repeats.op13_block_repeats,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_hilbert_shards": hilbert_shards.OP2_SQL,
        "op3_url_rules": url_rules.OP3_SQL,
        "op5_fm_decontam": fm_decontam.OP5_SQL,
        "op7_chat_format": chat_format.OP7_SQL,
        "op11_hard_negatives": hard_negatives.OP11_SQL,
        "op13_block_repeats": block_repeats.OP13_SQL,
    }
