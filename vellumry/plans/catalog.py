"""All queries of the core library and their SQL counterparts."""

from __future__ import annotations

from vellumry.plans import data_queries, format_queries, golden

FLAGSHIP = "format_markdown_auto"
_MODULES = [data_queries, format_queries, golden]


def queries() -> dict:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
