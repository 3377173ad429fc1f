"""All registered queries of the price engine and their SQL."""

from __future__ import annotations

from .plans import anomaly_queries, history_queries, identity_queries, operations_queries, report_queries, response_queries, source_queries, streaming_queries

MODULES = (history_queries, identity_queries, operations_queries, response_queries, report_queries, anomaly_queries, source_queries, streaming_queries)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
