"""Operators for training-data pipelines over documents, pages and embeddings."""

from __future__ import annotations

import importlib

MODULES = ("substrings", "warc", "tiling", "licences", "toxicity", "mixing", "quality", "kdtree", "jaccard",
           "token_files", "similarity_sketch", "lexical_search", "conversation_trie")


def load_queries() -> tuple[dict, dict]:
    """The queries of the operators and the SQL of those that SQL can express."""
    queries, sql = {}, {}
    for m in MODULES:
        module = importlib.import_module(f"{__name__}.{m}")
        queries |= module.QUERIES
        sql |= module.ORACLES
    return queries, sql
