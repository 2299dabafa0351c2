"""The engine's registered queries and their SQL."""

from __future__ import annotations

from . import formula_queries, moving_queries, privacy_queries, rule_queries, table_queries
from .privacy_queries import flagship

PARTS = [privacy_queries, rule_queries, formula_queries, moving_queries, table_queries]


def queries() -> dict:
    return {k: v for p in PARTS for k, v in p.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for p in PARTS for k, v in p.oracle_sql().items()}


__all__ = ["flagship", "oracle_sql", "queries"]
