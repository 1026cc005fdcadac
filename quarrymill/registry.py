"""All queries over the reference's operators by name, and the SQL that DuckDB runs for each."""

from __future__ import annotations

from .plans import doc_queries, lookup_queries, more_queries, page_queries, report_queries, site_queries

MODULES = [page_queries, doc_queries, more_queries, site_queries, report_queries, lookup_queries]


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.Q.items()}


def oracle_sql() -> dict:
    return {k: v for m in MODULES for k, v in m.S.items()}
