"""The registered queries and the SQL that states the same results."""

from tidemark.plans import arrivals, attribution, evidence, functions, graph, identity, journey, live, payloads, quality, queues, reporting, spend  # noqa: F401
from tidemark.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
