"""Every query of the library with its DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftline.plans import detector_queries, event_queries, graph_queries, monitor_queries, more_queries, parity_queries, retrieval_queries

FLAGSHIP = "graph_sankey"
MODULES = [graph_queries, detector_queries, retrieval_queries, event_queries, more_queries, parity_queries, monitor_queries]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.SQL.items()}
