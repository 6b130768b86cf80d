"""The corpus queries: name -> (query, SQL or None)."""

from __future__ import annotations

from . import (
    decontaminate, exact_dedup, jaccard_join, lexical_search, lm_score, mixing, period_runs, pii, quality_rules, sharding,
    sp_codec, suffix_dedup, token_binary,
)

QUERIES = {
    "op1_quality_rules": (quality_rules.op1_quality_rules, None),
    "op2_lm_scoring": (lm_score.op2_lm_scoring, None),
    "op3_sharding": (sharding.op3_sharding, None),
    "op4_sentencepiece": (sp_codec.op4_sentencepiece, None),
    "op5_pii_surrogates": (pii.op5_pii_surrogates, None),
    "op6_token_binary": (token_binary.op6_token_binary, None),
    "op7_exact_dedup": (exact_dedup.op7_exact_dedup, exact_dedup.OP7_SQL),
    "op8_suffix_dedup": (suffix_dedup.op8_suffix_dedup, None),
    "op9_jaccard_join": (jaccard_join.op9_jaccard_join, None),
    "op10_mixing": (mixing.op10_mixing, None),
    "op11_decontaminate": (decontaminate.op11_decontaminate, decontaminate.OP11_SQL),
    "op12_period_runs": (period_runs.op12_period_runs, None),
    "op13_lexical_search": (lexical_search.op13_lexical_search, lexical_search.OP13_SQL),
}
