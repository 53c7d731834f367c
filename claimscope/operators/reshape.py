"""Reshape operators: union of positional projections, melt, pivot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


# U3
def union_all(*dfs: DataFrame) -> DataFrame:
    out = dfs[0]
    for d in dfs[1:]:
        out = out.union(d)
    return out


# U4
def distinct_rows(df: DataFrame) -> DataFrame:
    return df.distinct()


# U5
def melt(df: DataFrame, ids: Sequence[str], values: Sequence[str], var_name: str = "variable",
         value_name: str = "value", dropna: bool = True) -> DataFrame:
    """Wide -> long in one scan; optionally drop null values."""
    out = df.unpivot(list(ids), list(values), var_name, value_name)
    return out.where(F.col(value_name).isNotNull()) if dropna else out


# U6
def pivot_named_codes(claims: DataFrame, lookup: DataFrame, cols: Sequence[str]) -> DataFrame:
    """For every code column add ``<col>_Named``: the short description of
    the code, else the code itself; null where the code is null.

    Long -> join -> wide would shuffle the claims by row; the same result is
    one left join per column against the lookup (a dimension the size of the
    code system), which the planner broadcasts when it is small."""
    out = claims
    for c in cols:
        lk = lookup.select(F.col("Code").alias(f"_k_{c}"), F.col("ShortDescription").alias(f"_d_{c}"))
        out = out.join(lk, out[c] == lk[f"_k_{c}"], "left")
        out = out.withColumn(f"{c}_Named", F.when(F.col(c).isNotNull(), F.coalesce(F.col(f"_d_{c}"), F.col(c))))
        out = out.drop(f"_k_{c}", f"_d_{c}")
    return out


# U8
def transpose_by(df: DataFrame, id_col: str, value_cols: Sequence[str], levels: Sequence[str],
                 new_id: str = "column") -> DataFrame:
    """Swap rows and columns of a small result: unpivot, then pivot on the
    former row ids, whose values are given in ``levels``."""
    long = df.unpivot([id_col], list(value_cols), new_id, "_v")
    return long.groupBy(new_id).pivot(id_col, list(levels)).agg(F.first("_v"))
