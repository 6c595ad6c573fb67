"""How queries and their SQL are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

#: Blocks in DuckDB, as sources.tables.blocks makes them.
BLOCKS = """lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS BIGINT) AS ord FROM documents),
blocks AS (SELECT doc_id, ord, printf('b%04d', ord) AS id, CASE WHEN regexp_matches(text, '^\\s*([-*•]|\\d+[.)])\\s') THEN 'li' WHEN length(text) - length(replace(text, ' ', '')) + 1 <= 3 THEN 'sec' ELSE 'p' END AS type, text FROM lines)"""


def registry() -> tuple[dict[str, Query], dict[str, str], Callable]:
    queries: dict[str, Query] = {}
    sql: dict[str, str] = {}

    def query(name: str, text: str | None = None):
        def add(f: Query) -> Query:
            queries[name] = f
            if text:
                sql[name] = text
            return f

        return add

    return queries, sql, query
