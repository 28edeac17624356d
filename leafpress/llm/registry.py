"""Queries of the llm operators and their SQL twins."""

from __future__ import annotations

from leafpress.llm import ann, bpe, chat, elkan, fingerprint, langid, line_dedup, mixing, near_dup, quality, repair, toxicity, url_filter

_MODULES = (
    ("op1_winnowing", fingerprint.op1_winnowing, None),
    ("op2_language_id", langid.op2_language_id, None),
    ("op3_quality", quality.op3_quality, None),
    ("op4_prefix_forest", ann.op4_prefix_forest, None),
    ("op5_near_dup", near_dup.op5_near_dup, None),
    ("op6_url_filter", url_filter.op6_url_filter, None),
    ("op7_byte_bpe", bpe.op7_byte_bpe, None),
    ("op8_toxicity", toxicity.op8_toxicity, None),
    ("op9_cube_mixing", mixing.op9_cube_mixing, None),
    ("op10_line_dedup", line_dedup.op10_line_dedup, line_dedup.ORACLE_SQL),
    ("op11_chat_format", chat.op11_chat_format, chat.ORACLE_SQL),
    ("op12_structure_repair", repair.op12_structure_repair, repair.ORACLE_SQL),
    ("op13_elkan_clusters", elkan.op13_elkan_clusters, elkan.ORACLE_SQL),
)


def queries() -> dict:
    return {name: query for name, query, _ in _MODULES}


def oracle_sql() -> dict:
    return {name: sql for name, _, sql in _MODULES if sql}
