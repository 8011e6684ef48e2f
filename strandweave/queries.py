"""The queries for the reference's operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import design_queries, interval_queries, model_queries, score_queries, sequence_queries, source_queries, stack_queries, stat_queries, table_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
for _module in (design_queries, interval_queries, model_queries, score_queries, sequence_queries, source_queries, stack_queries, stat_queries, table_queries):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
