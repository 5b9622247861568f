"""All registered queries of the conversation engine, with their SQL."""

from __future__ import annotations

from parlance.plans import transcript_queries, vector_queries


def queries() -> dict:
    return transcript_queries.FOUND | vector_queries.FOUND


def oracle_sql() -> dict[str, str]:
    return transcript_queries.SQL | vector_queries.SQL
