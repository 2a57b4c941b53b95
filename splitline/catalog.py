"""The query catalogue: every query of the plan modules with its oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import aggregate_queries, board_queries, domain_queries, duplicate_queries, estimate_queries, io_queries, join_queries, place_queries, result_queries, sink_queries  # noqa: F401  (each registers its queries)
from .plans.base import ORACLES, QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
