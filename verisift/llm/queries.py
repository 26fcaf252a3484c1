"""The queries of the subpackage and their SQL."""

from __future__ import annotations

import importlib

#: query -> module of this subpackage; the function has the query's name, SQL is the module's attribute SQL if any.
MODULES = {
    "op1_toxicity": "toxicity",
    "op2_sharding": "sharding",
    "op3_ngram_jaccard_join": "jaccard",
    "op4_html_extraction": "html_text",
    "op5_license_scan": "licenses",
    "op6_quality_rules": "quality",
    "op7_best_fit_packing": "packing",
    "op8_source_mixing": "mixing",
    "op9_embedding_near_dedup": "embedding",
    "op10_token_output": "token_output",
    "op11_suffix_dedup": "suffix_dedup",
    "op12_conversation_repair": "conversation_repair",
    "op13_conversation_trie": "prefix_trie",
}


def _module(name: str):
    return importlib.import_module(f"verisift.llm.{MODULES[name]}")


def queries() -> dict:
    return {n: getattr(_module(n), n) for n in MODULES}


def oracle_sql() -> dict[str, str]:
    return {n: sql for n in MODULES if (sql := getattr(_module(n), "SQL", None))}
