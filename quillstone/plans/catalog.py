"""All registered queries of the retrieval engine and their oracle SQL."""

from . import base, queries_answer, queries_chunks, queries_reports, queries_search, queries_sources  # noqa: F401  each registers its queries

QUERIES: dict = base.QUERIES
ORACLE_SQL: dict = base.ORACLE_SQL
