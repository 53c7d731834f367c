"""Registered queries: sources, joins, reports, windows, reshape, expressions.

Tables follow the reference's cell order: reports that come after its
negative-stay filter run on ``valid_claims``; earlier ones and the two
exploratory notebooks on ``claims_full``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from claimscope.functions import expressions as X
from claimscope.functions.values import (
    AGE_LABELS,
    AGE_MIDPOINTS,
    AGE_ORDINALS,
    CHRONIC_CONDITIONS,
    DUP_KEYS_CLAIM,
    DUP_KEYS_DIAG_PROC,
    DUP_KEYS_FIVE,
    RACE_NAMES,
    STATE_NAMES,
)
from claimscope.operators import cleanup, reports as R, reshape, stats, windows
from claimscope.operators.claims import union_claims, valid_stay, with_length_of_stay
from claimscope.operators.features import ROW_ID_COLS
from claimscope.plans.base import query, rounded
from claimscope.session import saved
from claimscope.plans.sqlgen import (
    age_group_sql,
    box_sql,
    case_map,
    chronic_long_sql,
    count_equal_sql,
    count_not_null_sql,
    density_sql,
    describe_sql,
    diag_cols,
    histogram_sql,
    proc_cols,
    q,
    row_id_sql,
    stack_sql,
)
from claimscope.sources import fixture as fx
from claimscope.sources.fixture import LABEL, PATIENT

CLAIM_COLS_N = 31


def full(spark, d, *sides):
    """All claims with the columns of the named sides."""
    return fx.claims_with(spark, d, *sides)


def valid(spark, d, *sides):
    return valid_stay(full(spark, d, *sides))


def valid_dup(spark, d, *sides):
    return valid_stay(fx.with_second_copies(full(spark, d, *sides)))


# ---------------------------------------------------------------- sources
@query("s05_table_shapes", f"""
select 'claims_full' as "table", count(*) as n_rows, cast(54 as integer) as n_cols from claims_full
union all select 'beneficiary', count(*), cast(23 as integer) from beneficiary
union all select 'provider_label', count(*), cast(2 as integer) from provider_label
union all select 'inpatient', count(*), cast({CLAIM_COLS_N - 1} as integer) from inpatient
union all select 'outpatient', count(*), cast({CLAIM_COLS_N - 5} as integer) from outpatient
union all select 'roster', count(*), cast(1 as integer) from (select distinct Provider from claims_src)
""", ("S5", "S8"))
def s05_table_shapes(spark, d):
    from claimscope.sources.readers import table_shapes

    ip, op = fx.inpatient_outpatient(spark, d)
    return table_shapes({
        "claims_full": fx.claims_full(spark, d),
        "beneficiary": fx.beneficiary(spark, d),
        "provider_label": fx.provider_label(spark, d),
        "inpatient": ip,
        "outpatient": op,
        "roster": fx.roster(spark, d),
    })


@query("s06_head", f"""
select ClaimID, Provider, BeneID, ClaimStartDt, InscClaimAmtReimbursed, PotentialFraud from (
  select *, {row_id_sql(['ClaimID', 'Provider', 'BeneID', 'ClaimStartDt', 'ClaimEndDt', 'AttendingPhysician', 'InscClaimAmtReimbursed'])} as rid
  from claims_full) order by ClaimID, rid limit 5
""", "S6")
def s06_head(spark, d):
    from claimscope.sources.readers import head

    cf = windows.with_row_id(
        full(spark, d, LABEL),
        ["ClaimID", "Provider", "BeneID", "ClaimStartDt", "ClaimEndDt", "AttendingPhysician", "InscClaimAmtReimbursed"],
        "rid",
    )
    return head(cf, 5, ["ClaimID", "rid"]).select(
        "ClaimID", "Provider", "BeneID", "ClaimStartDt", "InscClaimAmtReimbursed", "PotentialFraud"
    )


@query("s03_code_lookup", "select Code, LongDescription, ShortDescription from code_lookup", ("S3", "X11"))
def s03_code_lookup(spark, d):
    return fx.code_lookup(spark, d)


# ---------------------------------------------------------------- joins / union
@query("j01_claims_full", "select * from claims_full", ("J1", "J2", "U1", "P1"), headline=True)
def j01_claims_full(spark, d):
    return full(spark, d, PATIENT, LABEL)


@query("u01_union_claims", """
select *, 'Inpatient' as Source from inpatient
union all by name
select *, 'Outpatient' as Source from outpatient
""", ("U1", "P1"))
def u01_union_claims(spark, d):
    ip, op = fx.inpatient_outpatient(spark, d)
    return union_claims(ip, op)


@query("j04_merge_counts", """
select coalesce(i.Provider, o.Provider) as Provider,
  coalesce(i.n, 0) as InpatientClaimCount, coalesce(o.n, 0) as OutpatientClaimCount,
  coalesce(i.n, 0) + coalesce(o.n, 0) as TotalClaims
from (select Provider, count(*) as n from inpatient where Provider is not null group by Provider) i
full outer join (select Provider, count(*) as n from outpatient where Provider is not null group by Provider) o
on i.Provider = o.Provider
""", ("J4", "A4"))
def j04_merge_counts(spark, d):
    ip, op = fx.inpatient_outpatient(spark, d)
    return R.claim_volume_two_files(ip, op, k=None)


@query("j06_claims_of_frequent_patients", """
select BeneID, count(*) as n_claims, cast(sum(InscClaimAmtReimbursed) as bigint) as total_reimbursed
from valid_claims
where BeneID in (select BeneID from valid_claims group by BeneID having count(distinct Provider) >= 45)
group by BeneID
""", ("J6", "P6"))
def j06_claims_of_frequent_patients(spark, d):
    v = valid(spark, d)
    ids = R.patient_profile(v).where(F.col("NumProviders") >= 45).select("BeneID")
    sub = v.join(ids, "BeneID", "left_semi")
    return sub.groupBy("BeneID").agg(
        F.count(F.lit(1)).alias("n_claims"), F.sum("InscClaimAmtReimbursed").cast("bigint").alias("total_reimbursed")
    )


# ---------------------------------------------------------------- reports
@query("a01_label_distribution", """
select PotentialFraud, count(*) as count,
  cast(count(*) as double) / sum(count(*)) over () as proportion,
  round_even(cast(count(*) as double) / sum(count(*)) over () * 100, 2) as percent
from claims_full where PotentialFraud is not null group by PotentialFraud
""", ("A1", "W5", "X14"))
def a01_label_distribution(spark, d):
    return R.label_distribution(full(spark, d, LABEL))


@query("a02_claims_per_provider", """
select Provider, count(*) as ClaimCount from claims_full where Provider is not null
group by Provider order by ClaimCount desc, Provider limit 15
""", ("A2", "O2"))
def a02_claims_per_provider(spark, d):
    return R.claims_per_provider(full(spark, d), 15)


@query("a03_top_reimbursed", """
select Provider, cast(coalesce(sum(InscClaimAmtReimbursed), 0) as bigint) as TotalReimbursement
from claims_full where Provider is not null group by Provider order by TotalReimbursement desc, Provider limit 10
""", ("A3", "O2"))
def a03_top_reimbursed(spark, d):
    return R.top_reimbursed(full(spark, d), 10)


@query("a04_claim_volume", """
select Provider, cast(count_if(Source = 'Inpatient') as bigint) as InpatientClaimCount,
  cast(count_if(Source = 'Outpatient') as bigint) as OutpatientClaimCount,
  cast(count_if(Source = 'Inpatient') + count_if(Source = 'Outpatient') as bigint) as TotalClaims
from claims_full where Provider is not null group by Provider order by TotalClaims desc, Provider limit 10
""", ("A4", "O2"))
def a04_claim_volume(spark, d):
    return R.claim_volume(full(spark, d), 10)


@query("a05_chronic_percent", f"""
select Condition, PotentialFraud as Fraud,
  cast(sum(case when flag = 2 then 0 else flag end) as double) / count(flag) * 100 as Percent
from ({chronic_long_sql('claims_full', 'PotentialFraud is not null')}) group by Condition, PotentialFraud
""", ("A5", "P13", "U5", "U8"))
def a05_chronic_percent(spark, d):
    return R.chronic_percent(full(spark, d, PATIENT, LABEL))


@query("a06_chronic_mean_raw", f"""
select Condition,
  cast(sum(flag) filter (where PotentialFraud = 'No') as double) / count(flag) filter (where PotentialFraud = 'No') as "No",
  cast(sum(flag) filter (where PotentialFraud = 'Yes') as double) / count(flag) filter (where PotentialFraud = 'Yes') as "Yes"
from ({chronic_long_sql('claims_full', 'PotentialFraud is not null')}) group by Condition
""", ("A6", "U7", "U8"))
def a06_chronic_mean_raw(spark, d):
    return R.chronic_mean_raw(full(spark, d, PATIENT, LABEL))


@query("a07_condition_fraud_stats", f"""
select replace(Condition, 'ChronicCond_', '') as Condition, count(*) as TotalWithCondition,
  cast(count_if(PotentialFraud = 'Yes') as bigint) as FraudCount,
  cast(count_if(PotentialFraud = 'No') as bigint) as NoFraudCount,
  coalesce(round_even(case when count(PotentialFraud) = 0 then null
       else cast(count_if(PotentialFraud = 'Yes') as double) / (count_if(PotentialFraud = 'Yes') + count_if(PotentialFraud = 'No')) end * 100, 2), 0.0) as PctFraud,
  coalesce(round_even(case when count(PotentialFraud) = 0 then null
       else cast(count_if(PotentialFraud = 'No') as double) / (count_if(PotentialFraud = 'Yes') + count_if(PotentialFraud = 'No')) end * 100, 2), 0.0) as PctNoFraud
from ({chronic_long_sql('claims_full')}) where flag = 1 group by Condition
""", ("A7", "X12", "X14", "P5"))
def a07_condition_fraud_stats(spark, d):
    return R.condition_fraud_stats(full(spark, d, PATIENT, LABEL))


@query("a08_condition_fraud_long", f"""
with s as (
  select replace(Condition, 'ChronicCond_', '') as Condition,
    count_if(PotentialFraud = 'Yes') as y, count_if(PotentialFraud = 'No') as n
  from ({chronic_long_sql('claims_full')}) where flag = 1 group by Condition)
select Condition, 'Yes' as FraudStatus, coalesce(case when y + n = 0 then null else cast(y as double) / (y + n) end * 100, 0.0) as Percentage from s
union all
select Condition, 'No', coalesce(case when y + n = 0 then null else cast(n as double) / (y + n) end * 100, 0.0) from s
""", ("A8", "U5", "X12"))
def a08_condition_fraud_long(spark, d):
    return R.condition_fraud_long(full(spark, d, PATIENT, LABEL))


def _describe(name, table_sql, build, value, ops=("A9",)):
    @query(name, describe_sql(table_sql, "PotentialFraud", value), ops)
    def _q(spark, d):
        return rounded(R.describe_by(build(spark, d), "PotentialFraud", value),
                       {"std": 6, "p25": 6, "p50": 6, "p75": 6})
    return _q


_describe("a09_describe_reimbursed", "claims_full", lambda s, d: full(s, d, LABEL), "InscClaimAmtReimbursed")
_describe("a09_describe_stay", "(select *, ClaimEndDt - ClaimStartDt as LengthOfStay from valid_claims)",
          lambda s, d: with_length_of_stay(valid(s, d, LABEL)), "LengthOfStay", ("A9", "X3", "P6"))
_describe("a09_describe_physicians", """(
  select pp.Provider, pp.NumUniquePhysicians, l.PotentialFraud from (
    select Provider, count(distinct Physician) as NumUniquePhysicians from (
      select Provider, AttendingPhysician as Physician from valid_claims
      union all select Provider, OperatingPhysician from valid_claims
      union all select Provider, OtherPhysician from valid_claims) where Provider is not null and Physician is not null
    group by Provider) pp
  left join (select distinct Provider, PotentialFraud from valid_claims) l on pp.Provider = l.Provider)""",
          lambda s, d: R.physicians_per_provider(valid(s, d, LABEL)), "NumUniquePhysicians", ("A9", "A10"))
_describe("a09_describe_claims_per_patient",
          "(select BeneID, PotentialFraud, count(*) as ClaimCount from valid_claims where BeneID is not null and PotentialFraud is not null group by BeneID, PotentialFraud)",
          lambda s, d: R.claims_per_patient(valid(s, d, LABEL)), "ClaimCount", ("A9", "A11"))
_describe("a09_describe_claims_per_provider", """(
  select c.Provider, c.NumClaims, l.PotentialFraud from
  (select Provider, count(*) as NumClaims from valid_claims where Provider is not null group by Provider) c
  left join (select distinct Provider, PotentialFraud from valid_claims) l on c.Provider = l.Provider)""",
          lambda s, d: R.claims_per_provider_labelled(valid(s, d, LABEL)), "NumClaims", ("A9", "J5"))
_describe("a09_describe_providers_per_patient", """(
  select BeneID, count(distinct Provider) as ProviderCount,
    first(PotentialFraud order by ClaimStartDt, ClaimID, Provider) as PotentialFraud
  from valid_claims where BeneID is not null group by BeneID)""",
          lambda s, d: R.providers_per_patient(valid(s, d, LABEL)), "ProviderCount", ("A9", "A13", "W4"))
_describe("a09_describe_age", "(select *, 2009 - year(DOB) as Age from valid_claims)",
          lambda s, d: valid(s, d, PATIENT, LABEL).withColumn("Age", X.age_by_year("DOB")), "Age", ("A9", "X4", "X2"))


@query("a10_physicians_per_provider", """
select pp.Provider, pp.NumUniquePhysicians, l.PotentialFraud from (
  select Provider, count(distinct Physician) as NumUniquePhysicians from (
    select Provider, AttendingPhysician as Physician from valid_claims
    union all select Provider, OperatingPhysician from valid_claims
    union all select Provider, OtherPhysician from valid_claims) where Provider is not null and Physician is not null
  group by Provider) pp
left join (select distinct Provider, PotentialFraud from valid_claims) l on pp.Provider = l.Provider
""", ("A10", "U2", "U4", "J5", "P7"))
def a10_physicians_per_provider(spark, d):
    return R.physicians_per_provider(valid(spark, d, LABEL))


@query("a11_claims_per_patient", """
select BeneID, PotentialFraud, count(*) as ClaimCount from valid_claims
where BeneID is not null and PotentialFraud is not null group by BeneID, PotentialFraud
""", "A11")
def a11_claims_per_patient(spark, d):
    return R.claims_per_patient(valid(spark, d, LABEL))


@query("a12_providers_seen_hist", """
select NumProviders as NumProvidersSeen, count(*) as NumPatients from (
  select BeneID, count(distinct Provider) as NumProviders from valid_claims where BeneID is not null group by BeneID)
group by NumProviders
""", ("A12", "O1"))
def a12_providers_seen_hist(spark, d):
    return R.providers_seen_hist(valid(spark, d))


@query("a13_providers_per_patient", """
select BeneID, count(distinct Provider) as ProviderCount,
  first(PotentialFraud order by ClaimStartDt, ClaimID, Provider) as PotentialFraud
from valid_claims where BeneID is not null group by BeneID
""", ("A13", "W4"))
def a13_providers_per_patient(spark, d):
    return R.providers_per_patient(valid(spark, d, LABEL))


@query("a14_suspicious_patients", """
select BeneID, count(distinct Provider) as NumProviders,
  case when count(PotentialFraud) = 0 then null else cast(count_if(PotentialFraud = 'No') as double) / count(PotentialFraud) end as share_no,
  case when count(PotentialFraud) = 0 then null else cast(count_if(PotentialFraud = 'Yes') as double) / count(PotentialFraud) end as share_yes
from valid_claims where BeneID is not null group by BeneID having count(distinct Provider) > 10
order by NumProviders desc, BeneID limit 10
""", ("A14", "J7", "W5", "O1", "O2"))
def a14_suspicious_patients(spark, d):
    return R.suspicious_patients(valid(spark, d, LABEL), 10, 10)


A15_SQL = f"""
select BeneID, count(distinct ClaimID) as NumClaims, count(distinct Provider) as NumProviders,
  cast(sum({count_equal_sql(CHRONIC_CONDITIONS, 1)}) as double) / count(*) as AvgChronicConditions,
  cast(count_if(PotentialFraud = 'Yes') as double) / count(*) * 100 as PercentFraud
from valid_claims where BeneID is not null group by BeneID having count(distinct Provider) >= 15
order by PercentFraud desc, BeneID limit 10
"""


@query("a15_high_provider_summary", A15_SQL, ("A15", "X7", "F1", "J6", "O2"), headline=True)
def a15_high_provider_summary(spark, d):
    return R.high_provider_summary(valid(spark, d, PATIENT, LABEL), 15, 10)


@query("a16_fraud_by_age_group", f"""
with r as (
  select {age_group_sql('Age')} as AgeGroup,
    count_if(PotentialFraud = 'No') as n, count_if(PotentialFraud = 'Yes') as y
  from (select 2009 - year(DOB) as Age, PotentialFraud from valid_claims)
  where PotentialFraud is not null and {age_group_sql('Age')} is not null group by 1),
bins as (select * from (values {", ".join(f"({q(l)}, {i})" for i, l in enumerate(AGE_LABELS))}) t(AgeGroup, ord))
select bins.AgeGroup, cast(coalesce(n, 0) as bigint) as "No", cast(coalesce(y, 0) as bigint) as "Yes",
  cast(coalesce(n + y, 0) as bigint) as Total,
  round_even(case when n + y = 0 then null else cast(y as double) / (n + y) end * 100, 2) as PctFraud
from bins left join r on bins.AgeGroup = r.AgeGroup
""", ("A16", "X5", "X4", "U7"))
def a16_fraud_by_age_group(spark, d):
    return R.fraud_rate_by_age_group(valid(spark, d, PATIENT, LABEL), X.age_by_year("DOB"))


def _rate_sql(dim_expr: str, name: str) -> str:
    return f"""
select {name}, cast(n as bigint) as "No", cast(y as bigint) as "Yes", cast(n + y as bigint) as Total,
  round_even(case when n + y = 0 then null else cast(y as double) / (n + y) end * 100, 2) as PctFraud
from (select {dim_expr} as {name}, count_if(PotentialFraud = 'No') as n, count_if(PotentialFraud = 'Yes') as y
      from valid_claims where {dim_expr} is not null and PotentialFraud is not null group by 1)
"""


@query("a16_fraud_by_gender", _rate_sql("Gender", "Gender"), "A16")
def a16_fraud_by_gender(spark, d):
    return R.fraud_rate_by(valid(spark, d, PATIENT, LABEL), "Gender")


@query("a16_fraud_by_race", _rate_sql(case_map("Race", RACE_NAMES), "Race"), ("A16", "J8", "P12"))
def a16_fraud_by_race(spark, d):
    v = cleanup.refresh_column(valid(spark, d, LABEL), fx.beneficiary(spark, d), "BeneID", "Race")
    v = v.withColumn("Race", X.map_values("Race", RACE_NAMES))
    return R.fraud_rate_by(v, "Race")


@query("a16_fraud_by_state", _rate_sql("State", "State"), "A16")
def a16_fraud_by_state(spark, d):
    return R.fraud_rate_by(valid(spark, d, PATIENT, LABEL), "State")


@query("a17_top_states", f"""
select {case_map('State', STATE_NAMES)} as StateName, * from ({_rate_sql('State', 'State')})
order by PctFraud desc nulls last, State limit 10
""", ("A17", "P12", "O2"))
def a17_top_states(spark, d):
    return R.top_states(valid(spark, d, PATIENT, LABEL), 10)


@query("a17_top_states_15", f"""
select {case_map('State', STATE_NAMES)} as StateName, * from ({_rate_sql('State', 'State')})
order by PctFraud desc nulls last, State limit 15
""", ("A17", "P12", "O2"))
def a17_top_states_15(spark, d):
    return R.top_states(valid(spark, d, PATIENT, LABEL), 15)


def _dup_count_sql(table: str, keys: list[str]) -> str:
    ks = ", ".join(keys)
    return f"""select cast(coalesce(sum(n - 1), 0) as bigint) as n_duplicates, cast(count_if(n > 1) as bigint) as n_groups
from (select {ks}, count(*) as n from {table} group by {ks})"""


@query("a18_duplicate_claim_ids", _dup_count_sql("valid_claims", DUP_KEYS_CLAIM), ("A18", "W3"))
def a18_duplicate_claim_ids(spark, d):
    return R.duplicate_count(valid(spark, d), DUP_KEYS_CLAIM)


@query("a18_duplicate_five_keys", _dup_count_sql("(select * from claims_dup where ClaimEndDt - ClaimStartDt >= 0)", DUP_KEYS_FIVE),
       ("A18", "W3"))
def a18_duplicate_five_keys(spark, d):
    return R.duplicate_count(valid_dup(spark, d), DUP_KEYS_FIVE)


@query("a18_duplicate_diag_proc", _dup_count_sql("valid_claims", DUP_KEYS_DIAG_PROC), ("A18", "W3"))
def a18_duplicate_diag_proc(spark, d):
    return R.duplicate_count(valid(spark, d), DUP_KEYS_DIAG_PROC)


@query("a19_duplicate_label_split", f"""
with g as (select {", ".join(DUP_KEYS_FIVE)}, count(*) as n, count_if(PotentialFraud = 'Yes') as y, count_if(PotentialFraud = 'No') as no
           from claims_dup where ClaimEndDt - ClaimStartDt >= 0 group by {", ".join(DUP_KEYS_FIVE)} having count(*) > 1),
t as (select sum(n) as members, sum(y) as y, sum(no) as no from g)
select PotentialFraud, count, round_even(cast(count as double) / members * 100, 2) as percent from (
  select 'No' as PotentialFraud, cast(no as bigint) as count, members from t
  union all select 'Yes', cast(y as bigint), members from t) where count > 0
""", ("A19", "W3"))
def a19_duplicate_label_split(spark, d):
    return R.duplicate_label_split(valid_dup(spark, d, LABEL), DUP_KEYS_FIVE)


@query("a20_max_providers", """
select max(n) as max_providers from (select BeneID, count(distinct Provider) as n from valid_claims where BeneID is not null group by BeneID)
""", "A20")
def a20_max_providers(spark, d):
    return R.max_providers(valid(spark, d))


@query("a22_top_codes", f"""
with t as (select DiagnosisCode, count(*) as Count from ({stack_sql('claims_full', diag_cols(), [], 'v', 'DiagnosisCode')})
           where DiagnosisCode is not null group by DiagnosisCode order by Count desc, DiagnosisCode limit 10)
select DiagnosisCode, Count, LongDescription, ShortDescription, coalesce(ShortDescription, DiagnosisCode) as Label
from t left join code_lookup on t.DiagnosisCode = code_lookup.Code
""", ("A22", "J3", "P9", "U5", "S3", "X11"))
def a22_top_codes(spark, d):
    return R.top_codes(full(spark, d), fx.code_lookup(spark, d), 10)


@query("a23_top_codes_by_label", f"""
select PotentialFraud, DiagCode, Count from (
  select *, row_number() over (partition by PotentialFraud order by Count desc, DiagCode) as rn from (
    select PotentialFraud, DiagCode, count(*) as Count from ({stack_sql('claims_full', diag_cols(), ['PotentialFraud'], 'v', 'DiagCode')})
    where PotentialFraud is not null and DiagCode is not null group by PotentialFraud, DiagCode))
where rn <= 10
""", ("A23", "W2", "U5"))
def a23_top_codes_by_label(spark, d):
    return R.top_codes_by_label(full(spark, d, LABEL), 10)


_PHYSICIANS_SQL = """(
  select pp.Provider, pp.NumUniquePhysicians, l.PotentialFraud from (
    select Provider, count(distinct Physician) as NumUniquePhysicians from (
      select Provider, AttendingPhysician as Physician from valid_claims
      union all select Provider, OperatingPhysician from valid_claims
      union all select Provider, OtherPhysician from valid_claims) where Provider is not null and Physician is not null
    group by Provider) pp
  left join (select distinct Provider, PotentialFraud from valid_claims) l on pp.Provider = l.Provider)"""
_VOLUME_SQL = """(
  select c.Provider, c.NumClaims, l.PotentialFraud from
  (select Provider, count(*) as NumClaims from valid_claims where Provider is not null group by Provider) c
  left join (select distinct Provider, PotentialFraud from valid_claims) l on c.Provider = l.Provider)"""
_BOX = [
    ("a24_box_physicians_per_provider", _PHYSICIANS_SQL, "NumUniquePhysicians",
     lambda s, d: R.physicians_per_provider(valid(s, d, LABEL)), ("A24", "A10")),
    ("a24_box_claims_per_provider", _VOLUME_SQL, "NumClaims",
     lambda s, d: R.claims_per_provider_labelled(valid(s, d, LABEL)), ("A24", "J5")),
    ("a24_box_reimbursed", "claims_full", "InscClaimAmtReimbursed", lambda s, d: full(s, d, LABEL), ("A24",)),
    ("a24_box_stay", "(select *, ClaimEndDt - ClaimStartDt as LengthOfStay from valid_claims)", "LengthOfStay",
     lambda s, d: with_length_of_stay(valid(s, d, LABEL)), ("A24", "X3")),
    ("a24_box_claims_per_patient",
     "(select BeneID, PotentialFraud, count(*) as ClaimCount from valid_claims where BeneID is not null and PotentialFraud is not null group by BeneID, PotentialFraud)",
     "ClaimCount", lambda s, d: R.claims_per_patient(valid(s, d, LABEL)), ("A24", "A11")),
]


def _box(name, table_sql, value, build, ops):
    @query(name, box_sql(table_sql, "PotentialFraud", value), ops)
    def _q(spark, d):
        return rounded(stats.box_stats(build(spark, d), "PotentialFraud", value), {"q1": 6, "median": 6, "q3": 6})
    return _q


for _b in _BOX:
    _box(*_b)


@query("a25_hist_log_reimbursed", histogram_sql("(select ln(1 + InscClaimAmtReimbursed) as LogReimbursed from claims_full)",
                                                "LogReimbursed", 100), ("A25", "X1"))
def a25_hist_log_reimbursed(spark, d):
    c = full(spark, d).withColumn("LogReimbursed", X.log_reimbursed())
    return rounded(stats.histogram(c, "LogReimbursed", 100), {"lower": 6, "upper": 6})


@query("a25_hist_age_by_label", histogram_sql("(select 2009 - year(DOB) as Age, PotentialFraud from valid_claims)",
                                              "Age", 30, "PotentialFraud"), ("A25", "X4"))
def a25_hist_age_by_label(spark, d):
    c = valid(spark, d, PATIENT, LABEL).withColumn("Age", X.age_by_year("DOB"))
    return rounded(stats.histogram(c, "Age", 30, "PotentialFraud"), {"lower": 6, "upper": 6})


@query("a26_density_log_reimbursed", density_sql("(select ln(1 + InscClaimAmtReimbursed) as LogReimbursed from claims_full)",
                                                 "LogReimbursed", 200), ("A26", "X1"))
def a26_density_log_reimbursed(spark, d):
    c = full(spark, d).withColumn("LogReimbursed", X.log_reimbursed())
    return rounded(stats.density(c, "LogReimbursed", grid=200), {"x": 6, "density": 8})


@query("a26_density_age_by_label", density_sql("(select 2009 - year(DOB) as Age, PotentialFraud from valid_claims)",
                                               "Age", 200, "PotentialFraud"), ("A26", "X4"))
def a26_density_age_by_label(spark, d):
    c = valid(spark, d, PATIENT, LABEL).withColumn("Age", X.age_by_year("DOB"))
    return rounded(stats.density(c, "Age", "PotentialFraud", grid=200), {"x": 6, "density": 8})


@query("a27_count_by_gender", """
select Gender, PotentialFraud, count(*) as count from valid_claims
where Gender is not null and PotentialFraud is not null group by Gender, PotentialFraud
""", "A27")
def a27_count_by_gender(spark, d):
    return R.count_by(valid(spark, d, PATIENT, LABEL), "Gender")


@query("a27_count_by_race", f"""
select Race, PotentialFraud, count(*) as count from (select {case_map('Race', RACE_NAMES)} as Race, PotentialFraud from valid_claims)
where Race is not null and PotentialFraud is not null group by Race, PotentialFraud
""", ("A27", "P12"))
def a27_count_by_race(spark, d):
    v = valid(spark, d, PATIENT, LABEL).withColumn("Race", X.map_values("Race", RACE_NAMES))
    return R.count_by(v, "Race")


# ---------------------------------------------------------------- windows
@query("w01_overlap_count", """
select cast(count_if(ClaimStartDt <= prev) as bigint) as overlap_count from (
  select ClaimStartDt, lag(ClaimEndDt) over (partition by BeneID order by ClaimStartDt, ClaimEndDt, ClaimID) as prev
  from valid_claims)
""", ("W1", "O1"))
def w01_overlap_count(spark, d):
    return windows.overlap_count(valid(spark, d))


@query("w03_duplicate_flags", f"""
select cast(count_if(n > 1) as bigint) as n_flag_all, cast(count_if(rn > 1) as bigint) as n_flag_later from (
  select count(*) over (partition by {", ".join(DUP_KEYS_FIVE)}) as n,
         row_number() over (partition by {", ".join(DUP_KEYS_FIVE)} order by ClaimID) as rn
  from claims_dup)
""", ("W3", "A19"))
def w03_duplicate_flags(spark, d):
    dup = fx.with_second_copies(full(spark, d)).select(*DUP_KEYS_FIVE, "ClaimID")
    hot = windows.hot_keys(dup, DUP_KEYS_FIVE, windows.HOT_ROWS)
    a = windows.flag_duplicates(dup, DUP_KEYS_FIVE, keep=False, name="flag_all", hot=hot)
    b = windows.flag_duplicates(a, DUP_KEYS_FIVE, keep="first", order=["ClaimID"], name="flag_later", hot=hot)
    return b.agg(F.count_if("flag_all").cast("bigint").alias("n_flag_all"),
                 F.count_if("flag_later").cast("bigint").alias("n_flag_later"))


@query("w01_overlap_flags", """
select ClaimID, BeneID, ClaimStartDt, prev as PrevEndDt, coalesce(ClaimStartDt <= prev, false) as Overlap from (
  select ClaimID, BeneID, ClaimStartDt, lag(ClaimEndDt) over (partition by BeneID order by ClaimStartDt, ClaimEndDt, ClaimID) as prev
  from valid_claims)
""", "W1")
def w01_overlap_flags(spark, d):
    v = valid(spark, d).select("ClaimID", "BeneID", "ClaimStartDt", "ClaimEndDt")
    return windows.overlap_flags(v).select("ClaimID", "BeneID", "ClaimStartDt", "PrevEndDt", "Overlap")


@query("w03_duplicate_rows", f"""
select ClaimID, {", ".join(DUP_KEYS_FIVE)}, n > 1 as flag_all, rn > 1 as flag_later from (
  select ClaimID, {", ".join(DUP_KEYS_FIVE)}, count(*) over (partition by {", ".join(DUP_KEYS_FIVE)}) as n,
         row_number() over (partition by {", ".join(DUP_KEYS_FIVE)} order by ClaimID) as rn
  from claims_dup)
""", "W3")
def w03_duplicate_rows(spark, d):
    dup = fx.with_second_copies(full(spark, d)).select("ClaimID", *DUP_KEYS_FIVE)
    hot = windows.hot_keys(dup, DUP_KEYS_FIVE, windows.HOT_ROWS)
    a = windows.flag_duplicates(dup, DUP_KEYS_FIVE, keep=False, name="flag_all", hot=hot)
    return windows.flag_duplicates(a, DUP_KEYS_FIVE, keep="first", order=["ClaimID"], name="flag_later", hot=hot)


@query("w04_first_claim_per_patient", """
select BeneID, ClaimStartDt, ClaimID, Provider from (
  select BeneID, ClaimStartDt, ClaimID, Provider,
    row_number() over (partition by BeneID order by ClaimStartDt, ClaimID, Provider) as rn from valid_claims)
where rn = 1
""", "W4")
def w04_first_claim_per_patient(spark, d):
    v = valid(spark, d).select("BeneID", "ClaimStartDt", "ClaimID", "Provider")
    return windows.first_per_key(v, ["BeneID"], ["ClaimStartDt", "ClaimID", "Provider"])


@query("w06_row_id", f"""
select count(*) as n_rows, count(distinct RowID) as n_ids from (select {row_id_sql(ROW_ID_COLS)} as RowID from claims_full)
""", "W6")
def w06_row_id(spark, d):
    r = windows.with_row_id(full(spark, d), ROW_ID_COLS)
    return r.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("RowID").alias("n_ids"))


@query("w06_row_id_of_copies", f"""
select ClaimID, {row_id_sql(ROW_ID_COLS)} as RowID from claims_dup
""", "W6")
def w06_row_id_of_copies(spark, d):
    return windows.with_row_id(fx.with_second_copies(full(spark, d)), ROW_ID_COLS).select("ClaimID", "RowID")


# ---------------------------------------------------------------- reshape
@query("u05_melt_diagnosis", f"""
select ClaimID, variable, value from ({stack_sql('claims_full', diag_cols(), ['ClaimID'])}) where value is not null
""", ("U5", "P2"))
def u05_melt_diagnosis(spark, d):
    c = full(spark, d)
    return reshape.melt(c, ["ClaimID"], cleanup.cols_with_prefix(c, "ClmDiagnosisCode"))


@query("u03_physician_roles", """
select Physician, Role, count(*) as n_claims from (
  select coalesce(AttendingPhysician, 'none') as Physician, 'attending' as Role from claims_full
  union all select coalesce(OperatingPhysician, 'none'), 'operating' from claims_full
  union all select coalesce(OtherPhysician, 'none'), 'other' from claims_full) group by Physician, Role
""", ("U3", "P3", "P8", "P1"))
def u03_physician_roles(spark, d):
    c = full(spark, d)
    parts = [cleanup.rename(c.select(f"{r.title()}Physician"), {f"{r.title()}Physician": "Physician"}).withColumn("Role", F.lit(r))
             for r in ("attending", "operating", "other")]
    rows = cleanup.fill_const(reshape.union_all(*parts), "none", ["Physician"])
    return rows.groupBy("Physician", "Role").agg(F.count(F.lit(1)).alias("n_claims"))


@query("u08_transposed_totals", """
select "column", cast(max(case when Source = 'Inpatient' then v end) as bigint) as "Inpatient",
  cast(max(case when Source = 'Outpatient' then v end) as bigint) as "Outpatient"
from (select Source, unnest(['n_claims', 'reimbursed']) as "column", unnest([count(*), sum(InscClaimAmtReimbursed)]) as v
      from claims_full group by Source) group by "column"
""", "U8")
def u08_transposed_totals(spark, d):
    t = full(spark, d).groupBy("Source").agg(
        F.count(F.lit(1)).alias("n_claims"), F.sum("InscClaimAmtReimbursed").alias("reimbursed"))
    return reshape.transpose_by(t, "Source", ["n_claims", "reimbursed"], ["Inpatient", "Outpatient"])


@query("j09_join_on_row_id", f"""
select {row_id_sql(ROW_ID_COLS)} as RowID, ClaimID, cast(ClaimEndDt - ClaimStartDt as integer) as LengthOfStay from claims_dup
""", ("J9", "W6", "X3"))
def j09_join_on_row_id(spark, d):
    c = windows.with_row_id(fx.with_second_copies(full(spark, d)), ROW_ID_COLS)
    c = saved(c.select("RowID", "ClaimID", "ClaimStartDt", "ClaimEndDt"))  # keyed once for both sides
    stay = with_length_of_stay(c).select("RowID", "LengthOfStay")
    return cleanup.join_on_row_id(c.select("RowID", "ClaimID"), stay)


@query("u06_named_codes", "select ClaimID, Provider, " + ", ".join(
    f"case when c.{c} is not null then coalesce(l{i}.ShortDescription, c.{c}) end as {c}_Named"
    for i, c in enumerate(diag_cols())) + " from claims_full c " + " ".join(
    f"left join code_lookup l{i} on c.{c} = l{i}.Code" for i, c in enumerate(diag_cols())),
    ("U6", "J3", "P9"))
def u06_named_codes(spark, d):
    c = full(spark, d).select("ClaimID", "Provider", *diag_cols())
    out = reshape.pivot_named_codes(c, fx.code_lookup(spark, d), diag_cols())
    return out.select("ClaimID", "Provider", *[f"{c}_Named" for c in diag_cols()])


# ---------------------------------------------------------------- expressions
@query("x01_log_reimbursed", """
select ClaimID, InscClaimAmtReimbursed, round(ln(1 + InscClaimAmtReimbursed), 9) as LogReimbursed from claims_full
""", "X1")
def x01_log_reimbursed(spark, d):
    c = full(spark, d).select("ClaimID", "InscClaimAmtReimbursed", X.log_reimbursed().alias("LogReimbursed"))
    return rounded(c, {"LogReimbursed": 9})


@query("x03_stay_duration", """
select ClaimID, cast(ClaimEndDt - ClaimStartDt as integer) as ClaimDuration,
  case when ClaimEndDt - ClaimStartDt >= 0 then cast(ClaimEndDt - ClaimStartDt as integer) end as LengthOfStay
from claims_full
""", ("X3", "P6"))
def x03_stay_duration(spark, d):
    c = full(spark, d)
    dur = X.days_between("ClaimEndDt", "ClaimStartDt")
    return c.select("ClaimID", dur.alias("ClaimDuration"), F.when(dur >= 0, dur).alias("LengthOfStay"))


@query("x04_ages", """
select BeneID, DOB, cast(2009 - year(DOB) as integer) as AgeByYear,
  cast(floor((date '2009-12-31' - DOB) / 365) as integer) as AgeByDays from beneficiary
""", ("X4", "X2"))
def x04_ages(spark, d):
    b = fx.beneficiary(spark, d)
    dob = X.parse_date(F.col("DOB").cast("string"), lenient=True)
    return b.select("BeneID", dob.alias("DOB"), X.age_by_year(dob).cast("int").alias("AgeByYear"),
                    X.age_by_days(dob).alias("AgeByDays"))


@query("x05_age_groups", f"""
select Age, AgeGroup, {case_map('AgeGroup', AGE_MIDPOINTS)} as AgeMidpoint, {case_map('AgeGroup', AGE_ORDINALS)} as AgeOrdinal, count(*) as n
from (select Age, {age_group_sql('Age')} as AgeGroup from (select cast(2009 - year(DOB) as integer) as Age from valid_claims))
group by all
""", ("X5", "X6", "P12"))
def x05_age_groups(spark, d):
    c = valid(spark, d, PATIENT).select(X.age_by_year("DOB").cast("int").alias("Age"))
    c = c.withColumn("AgeGroup", X.age_group("Age"))
    c = c.withColumn("AgeMidpoint", X.age_midpoint("AgeGroup")).withColumn("AgeOrdinal", X.age_ordinal("AgeGroup"))
    return c.groupBy("Age", "AgeGroup", "AgeMidpoint", "AgeOrdinal").agg(F.count(F.lit(1)).alias("n"))


@query("x07_chronic_counts", f"""
select BeneID, {count_equal_sql(CHRONIC_CONDITIONS, 1)} as ChronicCount, {count_equal_sql(CHRONIC_CONDITIONS, 2)} as Num_ChronicCond_2,
  {" + ".join(f"(case when {c} = 2 then 0 else {c} end)" for c in CHRONIC_CONDITIONS)} as BinarySum
from beneficiary
""", ("X7", "X8", "P13", "X15", "F2"))
def x07_chronic_counts(spark, d):
    b = fx.beneficiary(spark, d)
    binary_sum = sum((X.binary_flag(c) for c in CHRONIC_CONDITIONS), F.lit(0))
    return b.select("BeneID", X.count_equal(CHRONIC_CONDITIONS, 1).alias("ChronicCount"),
                    X.count_equal(CHRONIC_CONDITIONS, 2).alias("Num_ChronicCond_2"), binary_sum.alias("BinarySum"))


@query("x09_code_counts", f"""
select ClaimID, {count_not_null_sql(diag_cols())} as num_diagnosis_codes, {count_not_null_sql(proc_cols())} as num_procedure_codes
from claims_full
""", ("X9", "P2"))
def x09_code_counts(spark, d):
    c = full(spark, d)
    return c.select("ClaimID", X.count_not_null(cleanup.cols_with_prefix(c, "ClmDiagnosisCode")).alias("num_diagnosis_codes"),
                    X.count_not_null(cleanup.cols_with_prefix(c, "ClmProcedureCode")).alias("num_procedure_codes"))


@query("x10_reimbursed_ratio", """
select ClaimID, InscClaimAmtReimbursed + DeductibleAmtPaid as TotalClaimAmt,
  case when InscClaimAmtReimbursed + DeductibleAmtPaid = 0 then 0.0
       else cast(InscClaimAmtReimbursed as double) / (InscClaimAmtReimbursed + DeductibleAmtPaid) end as ReimbursedRatio
from claims_full
""", "X10")
def x10_reimbursed_ratio(spark, d):
    c = full(spark, d)
    return c.select("ClaimID", (F.col("InscClaimAmtReimbursed") + F.col("DeductibleAmtPaid")).alias("TotalClaimAmt"),
                    X.reimbursed_ratio().alias("ReimbursedRatio"))


@query("x13_diag_doc", f"""
select ClaimID, concat_ws(' ', {", ".join(diag_cols())}) as DiagDoc,
  concat_ws(' ', {", ".join(f"coalesce({c}, 'nan')" for c in diag_cols())}) as DiagDocCompat
from claims_full
""", "X13")
def x13_diag_doc(spark, d):
    c = full(spark, d)
    return c.select("ClaimID", X.code_document(diag_cols()).alias("DiagDoc"),
                    X.code_document(diag_cols(), compat=True).alias("DiagDocCompat"))


@query("p12_value_maps", f"""
select BeneID, {case_map('Race', RACE_NAMES)} as RaceName, {case_map('State', STATE_NAMES)} as StateName,
  case when RenalDiseaseIndicator = 'Y' then 1 else 0 end as Renal
from beneficiary
""", ("P12", "P10"))
def p12_value_maps(spark, d):
    b = fx.beneficiary(spark, d)
    return b.select("BeneID", X.map_values("Race", RACE_NAMES).alias("RaceName"),
                    X.map_values("State", STATE_NAMES).alias("StateName"),
                    X.map_values("RenalDiseaseIndicator", {"Y": 1}, default=0).cast("int").alias("Renal"))


@query("p14_category_codes", """
select DiagnosisGroupCode, coalesce(cast(dense_rank() over (order by DiagnosisGroupCode) - 1 as integer), -1) as code, n from (
  select DiagnosisGroupCode, count(*) as n from claims_full group by DiagnosisGroupCode)
where DiagnosisGroupCode is not null
union all
select null, -1, count(*) from claims_full where DiagnosisGroupCode is null
""", "P14")
def p14_category_codes(spark, d):
    c = cleanup.category_codes(full(spark, d).select("DiagnosisGroupCode"), "DiagnosisGroupCode", "code")
    return c.groupBy("DiagnosisGroupCode", "code").agg(F.count(F.lit(1)).alias("n"))


@query("p18_missing_fractions", "select * from (select " + ", ".join(
    f"avg(case when {c} is null then 1.0 else 0.0 end) as {c}" for c in ["DeductibleAmtPaid", "OperatingPhysician",
                                                                         "DiagnosisGroupCode", "ClmDiagnosisCode_10",
                                                                         "ClmProcedureCode_1", "DOD"])
    + " from claims_full) unpivot (missing_fraction for \"column\" in (DeductibleAmtPaid, OperatingPhysician, DiagnosisGroupCode, ClmDiagnosisCode_10, ClmProcedureCode_1, DOD))",
    "P18")
def p18_missing_fractions(spark, d):
    cols = ["DeductibleAmtPaid", "OperatingPhysician", "DiagnosisGroupCode", "ClmDiagnosisCode_10", "ClmProcedureCode_1", "DOD"]
    return rounded(cleanup.missing_fractions(full(spark, d, PATIENT), cols), {"missing_fraction": 12})
