"""All queries of the library by name, and the SQL that they are checked against."""

from __future__ import annotations

from . import queries_articles, queries_blocks, queries_checks, queries_context, queries_content, queries_enrichment, queries_filters, queries_layout, queries_links, queries_state, queries_store, queries_tables

_MODULES = (queries_store, queries_blocks, queries_links, queries_state, queries_filters, queries_context, queries_content, queries_checks, queries_tables, queries_layout, queries_articles, queries_enrichment)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
SQL = {name: text for m in _MODULES for name, text in m.SQL.items()}
