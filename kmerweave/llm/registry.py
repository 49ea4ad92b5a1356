"""Queries and SQL of the training-data operators."""

from __future__ import annotations

from . import alignment, decontaminate, importance, jaccard, language, line_dedup, lm_score, mixing, packing, quality, secret_scan, topk, toxicity

QUERIES = {
    "op1_secrets": secret_scan.query,
    "op2_topk": topk.query,
    "op3_toxicity": toxicity.query,
    "op4_ngram_jaccard": jaccard.query,
    "op5_language": language.query,
    "op6_lm_score": lm_score.query,
    "op7_quality": quality.query,
    "op8_decontamination": decontaminate.query,
    "op9_line_dedup": line_dedup.query,
    "op10_packing": packing.query,
    "op11_mixing": mixing.query,
    "op12_importance": importance.query,
    "op13_alignment": alignment.query,
}

ORACLES = {
    "op2_topk": topk.SQL,
    "op4_ngram_jaccard": jaccard.SQL,
    "op8_decontamination": decontaminate.SQL,
    "op9_line_dedup": line_dedup.SQL,
    "op12_importance": importance.SQL,
}
