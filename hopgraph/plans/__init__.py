"""Registered queries over the driver tables."""

from hopgraph.plans import evaluate_queries, flow_queries, graph_queries, message_queries, provenance_queries  # noqa: F401
from hopgraph.plans.registry import ORACLES, QUERIES  # noqa: F401
