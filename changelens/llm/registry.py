"""Queries and oracle SQL of the training-data operators."""

from __future__ import annotations

from changelens.llm import chat_format, decontaminate, embedding_dedup, html_extract, language_id, lm_score, merkle, minhash_dedup, packing, quality, sentencepieces, spelling, url_filter

QUERIES = {
    "op1_html_extract": html_extract.query,
    "op2_quality": quality.query,
    "op3_url_filter": url_filter.query,
    "op4_decontaminate": decontaminate.query,
    "op5_language_id": language_id.query,
    "op6_lm_score": lm_score.query,
    "op7_minhash_dedup": minhash_dedup.query,
    "op8_embedding_dedup": embedding_dedup.query,
    "op9_packing": packing.query,
    "op10_chat_format": chat_format.query,
    "op11_merkle": merkle.query,
    "op12_spelling": spelling.query,
    "op13_sentencepiece": sentencepieces.query,
}

ORACLES = {
    "op1_html_extract": html_extract.ORACLE_SQL,
    "op4_decontaminate": decontaminate.ORACLE_SQL,
    "op7_minhash_dedup": minhash_dedup.ORACLE_SQL,
    "op8_embedding_dedup": embedding_dedup.ORACLE_SQL,
    "op10_chat_format": chat_format.ORACLE_SQL,
    "op11_merkle": merkle.ORACLE_SQL,
    "op12_spelling": spelling.ORACLE_SQL,
}
