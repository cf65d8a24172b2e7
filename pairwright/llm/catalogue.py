"""All numbered queries and their SQL twins."""

from __future__ import annotations

from importlib import import_module

from pairwright.llm.registry import QUERIES, TWINS

MODULES = ("quality", "neighbours", "toxicity", "lattice", "jaccard_join", "suffix_dedup", "secrets", "sentencepiece_bpe", "warc", "packing", "filter_audit", "pivot_search", "prefix_trie")
for _module in MODULES:
    import_module(f"pairwright.llm.{_module}")

__all__ = ["QUERIES", "TWINS"]
