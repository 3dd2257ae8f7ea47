"""Whole pipelines and the registered queries."""

from __future__ import annotations

import importlib

MODULES = ("trace_queries", "state_queries", "monitor_queries", "graph_queries", "program_queries")


def load_queries() -> tuple[dict, dict]:
    from .registry import ORACLES, QUERIES

    for m in MODULES:
        importlib.import_module(f"{__name__}.{m}")
    return dict(QUERIES), dict(ORACLES)
