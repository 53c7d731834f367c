"""All registered queries.  Importing this module registers every query."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from claimscope.plans import graph_queries, model_queries, report_queries  # noqa: F401  (register)
from claimscope.plans.base import REGISTRY, Query


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q.build for name, q in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q.sql for name, q in REGISTRY.items() if q.sql is not None}


def all_queries() -> dict[str, Query]:
    return dict(REGISTRY)
