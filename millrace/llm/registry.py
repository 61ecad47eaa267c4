"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from millrace.llm import byte_cnn, chat_format, decontaminate, fill_in_middle, html_main_text, katz, language_id, near_dup, quality_rules, sentencepiece_fst, sharding, spelling_variants, substring_dedup

_MODULES = (sharding, decontaminate, language_id, sentencepiece_fst, near_dup, quality_rules, chat_format, byte_cnn, html_main_text, katz, substring_dedup, fill_in_middle, spelling_variants)

QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
