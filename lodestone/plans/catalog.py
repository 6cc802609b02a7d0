"""All registered queries."""

from __future__ import annotations

from . import catalog_answers, catalog_crawl, catalog_dense, catalog_sources, catalog_sparse, catalog_text

PARTS = [catalog_sparse, catalog_dense, catalog_text, catalog_crawl, catalog_answers, catalog_sources]


def queries() -> dict:
    return {name: fn for part in PARTS for name, fn in part.r.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for part in PARTS for name, text in part.r.sql().items()}
