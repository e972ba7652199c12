"""Queries of this package and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from lexloom.llm import bpe, containment, embeddings, hard_negatives, html_text, lm, mixing, near_dup, phrases, pii, quality, sharding, suffixes

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_pii": pii.op2_pii,
    "op3_bpe": bpe.op3_bpe,
    "op4_suffixes": suffixes.op4_suffixes,
    "op5_embeddings": embeddings.op5_embeddings,
    "op6_html": html_text.op6_html,
    "op7_sharding": sharding.op7_sharding,
    "op8_lm": lm.op8_lm,
    "op9_near_dup": near_dup.op9_near_dup,
    "op10_containment": containment.op10_containment,
    "op11_hard_negatives": hard_negatives.op11_hard_negatives,
    "op12_phrases": phrases.op12_phrases,
    "op13_mixing": mixing.op13_mixing,
}

ORACLE_SQL = {
    "op9_near_dup": near_dup.ORACLE_SQL,
    "op10_containment": containment.ORACLE_SQL,
    "op11_hard_negatives": hard_negatives.ORACLE_SQL,
    "op12_phrases": phrases.ORACLE_SQL,
    "op13_mixing": mixing.ORACLE_SQL,
}
