"""Registered queries of the training-data operators, with their SQL where SQL can express them."""

from __future__ import annotations

from virosight.llm import ann, decontaminate, hard_negatives, language_id, licenses, lm_score, near_dups, pieces, quality, simhash, spelling, toxicity, url_filter

QUERIES = {
    "op1_url_filter": url_filter.op1_url_filter,
    "op2_benchmark_decontamination": decontaminate.op2_benchmark_decontamination,
    "op3_quality_classifier": quality.op3_quality_classifier,
    "op4_language_id": language_id.op4_language_id,
    "op5_lm_score": lm_score.op5_lm_score,
    "op6_sentencepiece": pieces.op6_sentencepiece,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_license_scan": licenses.op8_license_scan,
    "op9_nearest_neighbours": ann.op9_nearest_neighbours,
    "op10_minhash_near_dedup": near_dups.op10_minhash_near_dedup,
    "op11_hard_negatives": hard_negatives.op11_hard_negatives,
    "op12_simhash_near_dedup": simhash.op12_simhash_near_dedup,
    "op13_spelling_variants": spelling.op13_spelling_variants,
}

ORACLES = {
    "op1_url_filter": url_filter.ORACLE,
    "op2_benchmark_decontamination": decontaminate.ORACLE,
    "op10_minhash_near_dedup": near_dups.ORACLE,
    "op5_lm_score": lm_score.ORACLE,
    "op11_hard_negatives": hard_negatives.ORACLE,
}
