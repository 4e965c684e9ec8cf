"""The operators' registered queries and their SQL."""

from __future__ import annotations

from gridweft.llm import exact, knn, langid, mixing, near, pieces, quality, repeats, tokens, toxicity

QUERIES = {
    "op1_mix_sources": mixing.op1_mix_sources,
    "op2_tokens_orc": tokens.op2_tokens_orc,
    "op3_near_dedup": near.op3_near_dedup,
    "op4_remove_repeats": repeats.op4_remove_repeats,
    "op5_top_k": knn.op5_top_k,
    "op6_quality": quality.op6_quality,
    "op7_sentencepiece": pieces.op7_sentencepiece,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_language_id": langid.op9_language_id,
    "op10_exact_dedup": exact.op10_exact_dedup,
}

ORACLE_SQL = {
    "op1_mix_sources": mixing.OP1_SQL,
    "op5_top_k": knn.OP5_SQL,
    "op10_exact_dedup": exact.OP10_SQL,
}
