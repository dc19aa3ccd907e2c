"""All queries of the engine's own operators and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lorekeep.plans import (
    dump_queries,
    feed_queries,
    graph_state_queries,
    grounding_queries,
    html_stream_queries,
    part_queries,
    passage_queries,
    preview_queries,
    record_queries,
    relational_queries,
    review_queries,
    search_queries,
    validity_queries,
)

_FAMILIES = (search_queries, feed_queries, grounding_queries, relational_queries, validity_queries, record_queries, graph_state_queries, html_stream_queries, dump_queries, part_queries, review_queries, passage_queries, preview_queries)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
for family in _FAMILIES:
    QUERIES |= family.QUERIES
    ORACLE_SQL |= family.ORACLE_SQL
