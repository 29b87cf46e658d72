"""Every query of the base library, and its DuckDB counterpart."""

from plumbline.plans import head_queries, metric_queries, relational_queries, routing_queries, sampling_queries, sequence_queries, source_queries, text_queries  # noqa: F401  each module registers its queries
from plumbline.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
