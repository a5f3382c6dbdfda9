"""Operators for preparing language-model training corpora. Nothing else in the library imports this subpackage.

Tables of documents have `doc_id`, of any integer type (64 bits whole, may be null), and
`text`; others of their columns may have any name and type, and any letter case or dots.
Another type of doc_id is cast to one, and where that fails Spark's cast error is raised.
"""

from __future__ import annotations

from importlib import import_module

MODULES = ["suffix_tree_lm", "decontaminate", "phrase_automata", "token_store", "line_dedup", "quality", "suffix_dedup", "pii", "near_dedup", "packing"]


def queries() -> dict:
    return {k: v for m in MODULES for k, v in import_module(f"{__name__}.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in import_module(f"{__name__}.{m}").ORACLE.items()}
