"""The queries of this subpackage."""

from __future__ import annotations

from . import byte_bpe, importance, language_id, lexical_search, mixing, near_dedup, packing, prefix_trie, quality_rules, suffix_dedup, token_files, topk_search, toxicity

MODULES = (language_id, importance, token_files, quality_rules, mixing, suffix_dedup, topk_search, toxicity, near_dedup, packing, prefix_trie, byte_bpe, lexical_search)

QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLE_SQL = {name: sql for module in MODULES for name, sql in module.ORACLE_SQL.items()}
