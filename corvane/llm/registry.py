"""Queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from corvane.llm import bpe, decontaminate, dialogue, hamming, html_text, langid, lm_score, mixing, ngram_join, quality, runs, secrets, substring_dedup

QUERIES = {
    "op1_quality_classifier": quality.op1,
    "op2_language_id": langid.op2,
    "op3_suffix_dedup": substring_dedup.op3,
    "op4_ngram_join": ngram_join.op4,
    "op5_html_extraction": html_text.op5,
    "op6_hamming_top_k": hamming.op6,
    "op7_lm_scoring": lm_score.op7,
    "op8_source_mixing": mixing.op8,
    "op9_benchmark_decontamination": decontaminate.op9,
    "op10_secret_scan": secrets.op10,
    "op11_conversation_repair": dialogue.op11,
    "op12_bpe_coding": bpe.op12,
    "op13_periodic_runs": runs.op13,
}

ORACLE_SQL: dict[str, str] = {"op6_hamming_top_k": hamming.ORACLE_SQL}
