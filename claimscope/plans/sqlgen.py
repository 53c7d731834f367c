"""Small SQL-text generators for the DuckDB twins (shared fixed values)."""

from __future__ import annotations

from claimscope.functions.values import (
    AGE_EDGES,
    AGE_LABELS,
    CHRONIC_CONDITIONS,
    N_DIAGNOSIS,
    N_PROCEDURE,
)


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def case_map(expr: str, mapping: dict, else_: str = "null") -> str:
    whens = " ".join(f"when {expr} = {q(k) if isinstance(k, str) else k} then {q(v) if isinstance(v, str) else v}"
                     for k, v in mapping.items())
    return f"(case {whens} else {else_} end)"


def age_group_sql(age: str) -> str:
    whens = " ".join(
        f"when {age} >= {lo} and {age} < {hi} then {q(lbl)}"
        for lo, hi, lbl in zip(AGE_EDGES[:-1], AGE_EDGES[1:], AGE_LABELS)
    )
    return f"(case {whens} end)"


def diag_cols() -> list[str]:
    return [f"ClmDiagnosisCode_{i}" for i in range(1, N_DIAGNOSIS + 1)]


def proc_cols() -> list[str]:
    return [f"ClmProcedureCode_{i}" for i in range(1, N_PROCEDURE + 1)]


def count_equal_sql(cols: list[str], value: int) -> str:
    return "(" + " + ".join(f"(case when {c} = {value} then 1 else 0 end)" for c in cols) + ")"


def count_not_null_sql(cols: list[str]) -> str:
    return "(" + " + ".join(f"(case when {c} is not null then 1 else 0 end)" for c in cols) + ")"


def chronic_long_sql(table: str, where: str = "true") -> str:
    """(PotentialFraud, Condition, flag) rows, one per condition column."""
    return "\nunion all\n".join(
        f"select PotentialFraud, {q(c)} as Condition, {c} as flag from {table} where {where}"
        for c in CHRONIC_CONDITIONS
    )


def stack_sql(table: str, cols: list[str], keep: list[str], name: str = "variable", value: str = "value") -> str:
    keep_s = "".join(f"{k}, " for k in keep)
    return "\nunion all\n".join(f"select {keep_s}{q(c)} as {name}, {c} as {value} from {table}" for c in cols)


def row_id_sql(cols: list[str]) -> str:
    parts = ", ".join(f"coalesce(cast({c} as varchar), '␀')" for c in cols)
    copy = f"row_number() over (partition by {', '.join(cols)})"
    return f"md5(concat_ws('|', {parts}, cast({copy} as varchar)))"


def describe_sql(table: str, key: str, value: str) -> str:
    return f"""select {key}, count({value}) as count,
  cast(sum({value}) as double) / count({value}) as mean,
  round(stddev_samp({value}), 6) as std,
  cast(min({value}) as double) as min,
  round(quantile_cont({value}, 0.25), 6) as p25,
  round(quantile_cont({value}, 0.5), 6) as p50,
  round(quantile_cont({value}, 0.75), 6) as p75,
  cast(max({value}) as double) as max
from {table} where {key} is not null group by {key}"""


def box_sql(table: str, key: str, value: str) -> str:
    return f"""select b.{key}, round(q1, 6) as q1, round(median, 6) as median, round(q3, 6) as q3,
  cast(min(case when {value} >= q1 - 1.5 * (q3 - q1) and {value} <= q3 + 1.5 * (q3 - q1) then {value} end) as double) as whisker_low,
  cast(max(case when {value} >= q1 - 1.5 * (q3 - q1) and {value} <= q3 + 1.5 * (q3 - q1) then {value} end) as double) as whisker_high,
  cast(count_if(not ({value} >= q1 - 1.5 * (q3 - q1) and {value} <= q3 + 1.5 * (q3 - q1))) as bigint) as n_outliers
from (select {key}, {value} from {table} where {key} is not null and {value} is not null) b
join (select {key}, cast(quantile_cont({value}, 0.25) as double) as q1, cast(quantile_cont({value}, 0.5) as double) as median,
             cast(quantile_cont({value}, 0.75) as double) as q3
      from {table} where {key} is not null and {value} is not null group by {key}) qq on b.{key} = qq.{key}
group by b.{key}, q1, median, q3"""


def histogram_sql(table: str, value: str, bins: int, hue: str | None = None) -> str:
    hue_sel = f"{hue}, " if hue else ""
    hue_where = f" and {hue} is not null" if hue else ""
    return f"""select {hue_sel}bin, round(mn + (bin - 1) * ((mx - mn) / {bins}), 6) as lower,
  round(mn + bin * ((mx - mn) / {bins}), 6) as upper, count
from (
  select {hue_sel}cast(case when mx = mn then 1 else least(floor((cast({value} as double) - mn) / (mx - mn) * {bins}), {bins - 1}) + 1 end as integer) as bin,
         mn, mx, count(*) as count
  from (select {hue_sel}{value} from {table} where {value} is not null{hue_where}) b,
       (select cast(min({value}) as double) as mn, cast(max({value}) as double) as mx
        from {table} where {value} is not null{hue_where}) m
  group by all
)"""


def density_sql(table: str, value: str, grid: int, hue: str | None = None) -> str:
    hue_sel = f"{hue}, " if hue else ""
    hue_where = f" and {hue} is not null" if hue else ""
    join = f"using ({hue})" if hue else "on true"
    return f"""with base as (select {hue_sel}cast({value} as double) as x from {table} where {value} is not null{hue_where}),
w as (select {hue_sel}x, count(*) as w from base group by all),
p as (select {hue_sel}count(*) as n, stddev_samp(x) as sd, min(x) as lo, max(x) as hi from base group by all),
pb as (select *, sd * pow(cast(n as double), -0.2) as bw from p),
g as (select range as i from range({grid}))
select {hue_sel}cast(i as integer) as point, round(lo + i * (hi - lo) / {grid - 1}, 6) as x,
  round(sum(w * exp(-0.5 * ((lo + i * (hi - lo) / {grid - 1} - x) / bw) * ((lo + i * (hi - lo) / {grid - 1} - x) / bw)))
        / (n * bw * sqrt(2 * pi())), 8) as density
from w join pb {join} cross join g
group by {hue_sel}i, lo, hi, n, bw"""
