"""Runnable queries over the given tables, each with its SQL check where SQL can express it."""

from kerbline.plans import alert_queries, gap_queries, index_queries, ops_queries, quality_queries, scalar_queries, sink_queries, source_queries, stream_queries, track_queries  # noqa: F401
from kerbline.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
