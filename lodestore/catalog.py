"""All queries outside the training-data subpackage, by name, with their SQL."""

from __future__ import annotations

from lodestore.plans import store_queries as store


def queries() -> dict:
    return dict(store.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(store.SQL)
