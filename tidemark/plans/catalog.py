"""All registered queries: importing a module registers its own."""

from tidemark.plans import block_queries, model_queries, series_queries, signal_queries, table_queries  # noqa: F401
from tidemark.plans.queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
