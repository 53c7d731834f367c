"""Column expressions (scalar, JVM-side, whole-stage-codegen friendly).

Each function returns a ``Column``; none uses a Python UDF.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimscope.functions.values import (
    AGE_EDGES,
    AGE_LABELS,
    AGE_MIDPOINTS,
    AGE_ORDINALS,
    AGE_REFERENCE_DATE,
    AGE_REFERENCE_YEAR,
    LABEL_CODES,
    LABEL_YES,
)


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# X1
def log_reimbursed(c: str | Column = "InscClaimAmtReimbursed") -> Column:
    """log(1 + x)."""
    return F.log1p(_c(c))


# X2
def parse_date(c: str | Column, lenient: bool = False, fmt: str | None = None) -> Column:
    """Strict parse (bad text raises) or lenient parse (bad text -> null)."""
    col = _c(c)
    if lenient:
        return F.try_to_date(col.cast("string"), F.lit(fmt)) if fmt else F.try_to_date(col.cast("string"))
    return F.to_date(col, fmt) if fmt else F.to_date(col)


# X3
def days_between(end: str | Column, start: str | Column) -> Column:
    """Whole days from ``start`` to ``end`` (length of stay / claim duration)."""
    return F.date_diff(_c(end), _c(start))


# X4
def age_by_year(dob: str | Column = "DOB", year: int = AGE_REFERENCE_YEAR) -> Column:
    """``year - year(DOB)``."""
    return F.lit(year) - F.year(_c(dob))


def age_by_days(dob: str | Column = "DOB", ref: str = AGE_REFERENCE_DATE) -> Column:
    """``(ref - DOB).days // 365`` (floor division)."""
    return F.floor(F.date_diff(F.lit(ref).cast("date"), _c(dob)) / F.lit(365)).cast("int")


# X5
def age_group(age: str | Column = "Age") -> Column:
    """Left-closed bins over AGE_EDGES; ages outside [0, 100) give null."""
    a = _c(age)
    expr = None
    for lo, hi, label in zip(AGE_EDGES[:-1], AGE_EDGES[1:], AGE_LABELS):
        cond = (a >= lo) & (a < hi)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr


def age_group_order(group: str | Column = "AgeGroup") -> Column:
    """Position of an age-group label (0..7), for ordering."""
    return map_values(group, {label: i for i, label in enumerate(AGE_LABELS)})


# X6
def age_midpoint(group: str | Column = "AgeGroup") -> Column:
    return map_values(group, AGE_MIDPOINTS)


def age_ordinal(group: str | Column = "AgeGroup") -> Column:
    return map_values(group, AGE_ORDINALS)


# P12
def map_values(c: str | Column, mapping: Mapping, default=None) -> Column:
    """Dictionary remap through a literal map; unmapped -> ``default`` (null)."""
    m = F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])
    out = m[_c(c)]
    return out if default is None else F.coalesce(out, F.lit(default))


def label_code(c: str | Column = "PotentialFraud") -> Column:
    """Yes -> 1, No -> 0, other/null -> null."""
    return map_values(c, LABEL_CODES).cast("int")


def is_yes(c: str | Column = "PotentialFraud") -> Column:
    return _c(c) == LABEL_YES


# P13
def binary_flag(c: str | Column) -> Column:
    """1/2 coded flag -> 1/0; other values unchanged."""
    col = _c(c)
    return F.when(col == 2, F.lit(0)).otherwise(col)


# X7 / X8
def count_equal(cols: Sequence[str], value: int) -> Column:
    """Number of columns equal to ``value`` (null counts as not equal)."""
    return sum((F.coalesce((F.col(c) == value).cast("int"), F.lit(0)) for c in cols), F.lit(0))


# X9
def count_not_null(cols: Sequence[str]) -> Column:
    return sum((F.col(c).isNotNull().cast("int") for c in cols), F.lit(0))


# X10
def reimbursed_ratio(reimb: str | Column = "InscClaimAmtReimbursed", deduct: str | Column = "DeductibleAmtPaid") -> Column:
    """r / (r + d); 0 when the total is 0; null when any input is null."""
    total = _c(reimb) + _c(deduct)
    return F.when(total == 0, F.lit(0.0)).otherwise(_c(reimb) / total)


# X11
def clean_code(c: str | Column) -> Column:
    """Trim blanks and remove every literal '.'."""
    return F.replace(F.trim(_c(c)), F.lit("."), F.lit(""))


# X12
def strip_affix(c: str | Column, prefix: str = "", suffix: str = "") -> Column:
    """Remove a literal prefix and/or suffix (anchored)."""
    import re

    col = _c(c)
    if prefix:
        col = F.regexp_replace(col, "^" + re.escape(prefix), "")
    if suffix:
        col = F.regexp_replace(col, re.escape(suffix) + "$", "")
    return col


# X13
def code_document(cols: Sequence[str], compat: bool = False) -> Column:
    """Space-joined codes of one row.  ``compat=True`` writes null as the
    token ``nan`` like a string cast of a missing value does."""
    if compat:
        return F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("nan")) for c in cols])
    return F.concat_ws(" ", *[F.col(c).cast("string") for c in cols])


# X14
def round_half_even(c: str | Column, scale: int) -> Column:
    return F.bround(_c(c), scale)


def fixed4(c: str | Column) -> Column:
    return F.format_string("%.4f", _c(c))


# P11
def to_double_lenient(c: str | Column) -> Column:
    """Numeric conversion where text that is not a number becomes null."""
    return _c(c).cast("string").try_cast("double")


def pct(num: str | Column, den: str | Column, scale: int = 2) -> Column:
    """``round_half_even(num / den * 100, scale)``; null when den is 0."""
    return F.bround(F.try_divide(_c(num), _c(den)) * 100, scale)
