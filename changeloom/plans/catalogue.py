"""All registered queries."""

from changeloom.plans import graph_queries, ingest_queries, relation_queries, scalar_queries  # noqa: F401
from changeloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
