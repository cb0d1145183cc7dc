"""All queries of the library and their SQL."""

from lexmill.plans import korean_queries, note_queries, similar_queries, text_queries, workflow_queries  # noqa: F401 - importing registers the queries
from lexmill.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
