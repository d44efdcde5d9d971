"""All registered queries with their oracle SQL."""

from __future__ import annotations

import importlib

FAMILIES = ["risk_queries", "text_queries", "triple_queries", "version_queries", "case_queries", "retrieval_queries", "doc_queries", "source_queries"]


def _modules():
    return [importlib.import_module(f"{__package__}.{name}") for name in FAMILIES]


def queries() -> dict:
    out: dict = {}
    for module in _modules():
        out.update(module.FAMILY.queries)
    return out


def oracle_sql() -> dict:
    out: dict = {}
    for module in _modules():
        out.update(module.FAMILY.oracles)
    return out
