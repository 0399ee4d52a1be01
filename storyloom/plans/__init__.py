"""The registered queries of the story engine."""

from . import join_queries, metric_queries, ranking_queries, state_queries, text_queries  # noqa: F401
from .views_sql import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
