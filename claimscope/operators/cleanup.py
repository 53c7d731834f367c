"""Projection, filter and column-cleanup operators.

Column-set decisions (which columns to drop, what to impute) need one small
aggregate row of per-column statistics; that row is the only thing brought
to the driver.  Everything else stays lazy.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimscope.functions.expressions import to_double_lenient
from claimscope.operators.ranking import positions

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def is_numeric(dt: T.DataType) -> bool:
    return isinstance(dt, NUMERIC_TYPES)


# P2
def cols_with_prefix(df: DataFrame, prefix: str) -> list[str]:
    return [c for c in df.columns if c.startswith(prefix)]


def select_prefix(df: DataFrame, prefix: str, keep: Sequence[str] = ()) -> DataFrame:
    return df.select(*keep, *cols_with_prefix(df, prefix))


# P3
def rename(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(mapping))


# P4
def drop_cols(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Drop columns; absent names are ignored."""
    return df.drop(*cols)


# P7
def dropna_any(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    return df.dropna(how="any", subset=list(subset) if subset else None)


# P8
def fill_const(df: DataFrame, value, subset: Sequence[str] | None = None) -> DataFrame:
    return df.fillna(value, subset=list(subset) if subset else None)


# P10
def cast_cols(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast(t) for c, t in types.items()})


# P11
def to_numeric_lenient(df: DataFrame, cols: Sequence[str] | None = None, fill: float | None = 0.0) -> DataFrame:
    """Every column to double; text that is not a number becomes null, then
    ``fill`` (like ``to_numeric(errors='coerce')`` + ``fillna``).  Dates and
    booleans are not numbers and become null as well."""
    cols = list(cols or df.columns)
    out = df.withColumns({c: _lenient(df, c) for c in cols})
    return out if fill is None else out.fillna(fill, subset=cols)


def _lenient(df: DataFrame, c: str):
    dt = df.schema[c].dataType
    if is_numeric(dt):
        return F.col(c).cast("double")
    if isinstance(dt, T.StringType):
        return to_double_lenient(c)
    return F.lit(None).cast("double")


# P14
def category_codes(df: DataFrame, col: str, name: str | None = None) -> DataFrame:
    """Value -> 0-based position in the sorted distinct non-null values;
    null -> -1.  The distinct values are numbered by range, in many tasks."""
    name = name or col
    levels = df.select(col).where(F.col(col).isNotNull()).distinct()
    levels = positions(levels, col, "_code").withColumn("_code", F.col("_code").cast("int"))
    out = df.join(levels, on=col, how="left")
    out = out.withColumn("_code", F.coalesce(F.col("_code"), F.lit(-1)))
    cols = [F.col("_code").alias(name) if c == col else F.col(c) for c in df.columns]
    if name != col:
        cols = [F.col(c) for c in df.columns] + [F.col("_code").alias(name)]
    return out.select(*cols)


# P16
def drop_string_cols(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Drop every text column except those in ``keep``."""
    drop = [n for n, t in df.dtypes if t == "string" and n not in keep]
    return df.drop(*drop)


# P17
def single_valued_cols(df: DataFrame, cols: Sequence[str] | None = None) -> list[str]:
    """Columns with at most one distinct non-null value.  One aggregation
    of min and max per column (no distinct-count expansion)."""
    cols = list(cols or df.columns)
    aggs = []
    for c in cols:
        aggs += [F.min(c).alias(f"mn_{c}"), F.max(c).alias(f"mx_{c}")]
    row = df.agg(*aggs).first()
    return [c for c in cols if row[f"mn_{c}"] is None or row[f"mn_{c}"] == row[f"mx_{c}"]]


def drop_single_valued(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    return df.drop(*single_valued_cols(df, cols))


# P18
def missing_fractions(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """One row per column: fraction of nulls (single aggregation pass)."""
    cols = list(cols or df.columns)
    wide = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in cols])
    return wide.unpivot([], cols, "column", "missing_fraction")


def high_missing_cols(df: DataFrame, threshold: float = 0.9, cols: Sequence[str] | None = None) -> list[str]:
    cols = list(cols or df.columns)
    row = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in cols]).first()
    return [c for c in cols if row[c] is not None and row[c] > threshold]


# P19
def impute_values(df: DataFrame, cols: Sequence[str] | None = None) -> dict:
    """Fill values: numeric -> mean, other -> most frequent value (smallest
    on a tie; as text, like its counts).  Means are one aggregation; the other
    columns are unpivoted once and counted by (column, value), so no task
    holds the values of a column."""
    cols = list(cols or df.columns)
    numeric = [c for c in cols if is_numeric(df.schema[c].dataType)]
    other = [c for c in cols if c not in numeric]
    values = df.agg(*[F.avg(c).alias(c) for c in numeric]).first().asDict() if numeric else {}
    if other:
        texts = df.select(*[F.col(c).cast("string").alias(c) for c in other])
        counts = texts.unpivot([], other, "column", "value").where(F.col("value").isNotNull()).groupBy("column", "value").agg(
            F.count(F.lit(1)).alias("n"))
        best = counts.groupBy("column").agg(F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("value"))
        texts = {r["column"]: r["value"] for r in best.collect()}
        typed = [F.lit(texts[c]).cast(df.schema[c].dataType).alias(c) for c in other if c in texts]
        values |= df.sparkSession.range(1).select(*typed).first().asDict() if typed else {}
    return {c: values[c] for c in cols if values.get(c) is not None}


def impute_mean_mode(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    values = impute_values(df, cols)
    num = {c: v for c, v in values.items() if is_numeric(df.schema[c].dataType)}
    out = df.withColumns({c: F.col(c).cast("double") for c in num})
    exprs = {c: F.coalesce(F.col(c), F.lit(v)) for c, v in values.items()}
    return out.withColumns(exprs)


# J8
def refresh_column(df: DataFrame, dim: DataFrame, key: str, col: str) -> DataFrame:
    """Replace ``col`` by the value re-joined from ``dim`` on ``key``."""
    return df.drop(col).join(dim.select(key, col), on=key, how="left")


# J9
def join_on_row_id(left: DataFrame, right: DataFrame, key: str = "RowID") -> DataFrame:
    """Join two row-aligned tables on an explicit row key (never on position)."""
    return left.join(right, on=key, how="left")
