"""All queries of the engine and their SQL."""

from __future__ import annotations

from sparkloom.plans import graph_queries, ops_queries, pipeline_queries, text_queries

ALL = {**text_queries.Q, **graph_queries.Q, **ops_queries.Q, **pipeline_queries.Q}


def queries() -> dict:
    return {name: f for name, (f, _) in ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in ALL.items() if sql}
