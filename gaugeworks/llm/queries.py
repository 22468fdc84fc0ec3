"""Loads every operator module, which registers its query."""

from importlib import import_module

from gaugeworks.llm.registry import ORACLE, QUERIES

_MODULES = ("ann", "url_filter", "language", "token_files", "merge_replay", "lm_score", "jaccard_join", "mixing", "html_text", "order_minhash", "vector_codes", "prefix_trie", "quality")

for _name in _MODULES:
    import_module(f"gaugeworks.llm.{_name}")

__all__ = ["ORACLE", "QUERIES"]
