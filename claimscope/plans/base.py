"""Query registration: each named query = a Spark builder (spark, sf_dir) ->
DataFrame, plus (when SQL-expressible) the DuckDB twin over the same parquet
tables (``with_fixture`` CTEs + body)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimscope.plans.fixture_sql import with_fixture


@dataclass
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    operators: tuple[str, ...]
    headline: bool = False


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None, operators: tuple[str, ...] | str, headline: bool = False,
          extra_ctes: list[tuple[str, str]] | None = None):
    ops = (operators,) if isinstance(operators, str) else tuple(operators)

    def deco(fn: Callable[[SparkSession, str], DataFrame]):
        full_sql = with_fixture(sql, extra_ctes) if sql is not None else None
        REGISTRY[name] = Query(name, fn, full_sql, ops, headline)
        return fn

    return deco


def rounded(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    """Round float outputs whose last bits depend on summation order."""
    return df.withColumns({c: F.round(F.col(c), d) for c, d in digits.items()})
