"""Panels derived from the test tables, and the registered queries over them."""
from panelspark.plans import (correlation_queries, event_queries, graph_queries,  # noqa: F401
                              ingest_queries, panel_queries)
from panelspark.plans.registry import REGISTRY

__all__ = ["REGISTRY"]
