"""Queries over whole tables, question plans and report datasets."""

from __future__ import annotations

import importlib

MODULES = ("q_records", "q_search", "q_graph", "q_links", "q_profile", "q_extract", "q_questions", "q_reports", "q_more", "q_tables")


def load() -> tuple[dict, dict]:
    """All registered queries and their SQL."""
    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}")
    from .registry import ORACLES, QUERIES

    return dict(QUERIES), dict(ORACLES)
