"""All registered queries."""

from clipledger.plans import (
    aggregate_queries,
    catalog_queries,
    join_queries,
    project_queries,
    reuse,
    source_queries,
    stream_queries,
    window_queries,
)

_SECTIONS = [
    aggregate_queries, project_queries, join_queries, window_queries, source_queries, catalog_queries,
    stream_queries, reuse,
]


def queries():
    return {n: f for s in _SECTIONS for n, f in s.REG.queries.items()}


def oracle_sql():
    return {n: q for s in _SECTIONS for n, q in s.REG.sql.items()}
