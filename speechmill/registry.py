"""All queries of the library with their oracle SQL, gathered from the modules of ``plans``."""

from __future__ import annotations

from speechmill.plans import aggregate_queries, align_queries, order_queries, table_queries, text_queries  # noqa: F401  they register
from speechmill.plans.base import ORACLE, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
