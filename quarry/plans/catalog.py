"""All queries of the library with their SQL."""

from __future__ import annotations

from quarry.plans import clean_queries, eda_queries, model_queries, report_queries, split_queries, text_queries  # noqa: F401  they register themselves
from quarry.plans.registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
