"""Driver queries of the text operators: name -> (query, DuckDB SQL or None)."""

from __future__ import annotations

from tidewater.llm import (chat_format, decontaminate, hard_negatives, language_id, mixing, near_dedup, quality_classifier, quality_rules, suffix_dedup,
                           token_alignment, token_counts, toxicity, url_filter)

REGISTRY = {
    "op1_near_dedup": (near_dedup.op1_near_dedup, None),
    "op2_token_counts": (token_counts.op2_token_counts, None),
    "op3_mixing": (mixing.op3_mixing, None),
    "op4_chat_format": (chat_format.op4_chat_format, chat_format.OP4_SQL),
    "op5_toxicity": (toxicity.op5_toxicity, None),
    "op6_decontaminate": (decontaminate.op6_decontaminate, None),
    "op7_quality_rules": (quality_rules.op7_quality_rules, quality_rules.OP7_SQL),
    "op8_url_filter": (url_filter.op8_url_filter, None),
    "op9_quality_classifier": (quality_classifier.op9_quality_classifier, None),
    "op10_language_id": (language_id.op10_language_id, None),
    "op11_hard_negatives": (hard_negatives.op11_hard_negatives, hard_negatives.OP11_SQL),
    "op12_suffix_dedup": (suffix_dedup.op12_suffix_dedup, None),
    "op13_token_alignment": (token_alignment.op13_token_alignment, None),
}
