"""Registered queries over the driver's tables, each with its SQL twin."""

from pulseframe.queries import (  # noqa: F401
    q_anomalies, q_attribution, q_baseline, q_clean, q_facts, q_graph, q_history, q_reports, q_rules, q_score, q_sources,
    q_stats, q_streaming,
)
from pulseframe.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
