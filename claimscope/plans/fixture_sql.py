"""The fixture mapping as DuckDB SQL text (the oracle twin of
``claimscope.sources.fixture``).  ``with_fixture(body)`` prefixes a query with
the CTEs it may use: claims_src, beneficiary, provider_label, code_lookup,
claims_full, claims_dup, valid_claims, inpatient, outpatient, roster.
"""

from __future__ import annotations

from claimscope.functions.values import CHRONIC_CONDITIONS, N_DIAGNOSIS, N_PROCEDURE


def _claims_src() -> str:
    diag = ",\n".join(
        f"  case when {i} <= 1 + l_partkey % 10 then cast(100 + (l_partkey*{i} + l_linenumber) % 60 as varchar) end"
        f" as ClmDiagnosisCode_{i}"
        for i in range(1, N_DIAGNOSIS + 1)
    )
    proc = ",\n".join(
        f"  case when l_returnflag = 'A' and {i} <= l_partkey % 4 then cast(3000 + (l_partkey*{i}) % 40 as integer) end"
        f" as ClmProcedureCode_{i}"
        for i in range(1, N_PROCEDURE + 1)
    )
    return f"""select
  concat('CLM', cast(l_orderkey as varchar), '_', cast(l_linenumber as varchar)) as ClaimID,
  concat('BENE', cast(o_custkey as varchar)) as BeneID,
  concat('PRV', cast(l_suppkey as varchar)) as Provider,
  cast(l_shipdate as date) as ClaimStartDt,
  cast(l_shipdate as date) + cast((l_partkey*7 + l_linenumber) % 25 - 2 as integer) as ClaimEndDt,
  case when l_partkey % 20 = 0 then cast(0 as bigint) else cast(floor(l_extendedprice) as bigint) end as InscClaimAmtReimbursed,
  case when l_linenumber = 5 then null else cast((l_partkey % 9) * 100 as bigint) end as DeductibleAmtPaid,
  case when l_partkey % 50 = 0 then null else concat('PHY', cast(l_partkey % 400 as varchar)) end as AttendingPhysician,
  case when l_partkey % 4 = 0 then concat('PHY', cast((l_partkey*3) % 400 as varchar)) end as OperatingPhysician,
  case when l_partkey % 3 = 0 then concat('PHY', cast((l_partkey*7) % 400 as varchar)) end as OtherPhysician,
  case when l_returnflag = 'A' then cast(l_shipdate as date) end as AdmissionDt,
  case when l_returnflag = 'A' then cast(l_shipdate as date) + cast((l_partkey*7 + l_linenumber) % 25 - 2 as integer) end as DischargeDt,
  case when l_returnflag = 'A' then cast(100 + l_partkey % 60 as varchar) end as ClmAdmitDiagnosisCode,
  case when l_returnflag = 'A' then cast(l_partkey % 300 as varchar) end as DiagnosisGroupCode,
  case when l_returnflag = 'A' then 'Inpatient' else 'Outpatient' end as Source,
{diag},
{proc}
from lineitem join orders on l_orderkey = o_orderkey"""


def _beneficiary() -> str:
    chronic = ",\n".join(
        f"  cast(case when (c_custkey*{j} + {j * j}) % {j + 2} = 0 then 1 else 2 end as integer) as {name}"
        for j, name in enumerate(CHRONIC_CONDITIONS, start=1)
    )
    return f"""select
  concat('BENE', cast(c_custkey as varchar)) as BeneID,
  date '1909-01-01' + cast((c_custkey*37) % 27000 as integer) as DOB,
  case when c_custkey % 120 = 0 then date '2009-12-01' end as DOD,
  cast(1 + c_custkey % 2 as integer) as Gender,
  cast(case when c_custkey % 97 = 0 then 4 when c_custkey % 5 = 1 then 2 when c_custkey % 5 = 2 then 3
            when c_custkey % 5 = 3 then 5 else 1 end as integer) as Race,
  case when c_custkey % 7 = 0 then 'Y' else '0' end as RenalDiseaseIndicator,
  cast(1 + c_custkey % 54 as integer) as State,
  cast(c_custkey % 200 as integer) as County,
{chronic},
  cast(floor(abs(c_acctbal)) as bigint) as IPAnnualReimbursementAmt,
  cast(c_custkey % 11 * 100 as bigint) as IPAnnualDeductibleAmt,
  cast(floor(abs(c_acctbal) * 0.25) as bigint) as OPAnnualReimbursementAmt,
  cast(c_custkey % 13 * 50 as bigint) as OPAnnualDeductibleAmt
from customer"""


_PROVIDER_LABEL = """select concat('PRV', cast(s_suppkey as varchar)) as Provider,
  case when s_acctbal < 2000 then 'Yes' else 'No' end as PotentialFraud
from supplier where s_suppkey % 33 <> 5"""

_CODE_LOOKUP_RAW = """select distinct
  concat(' ', substr(cast(99 + p_size as varchar), 1, 2), '.', substr(cast(99 + p_size as varchar), 3, 1), ' ') as Code,
  concat('Long ', cast(p_size as varchar)) as LongDescription,
  case when p_size % 10 = 0 then null else concat('Short ', cast(p_size as varchar)) end as ShortDescription
from part"""

_CODE_LOOKUP = """select replace(trim(Code), '.', '') as Code, LongDescription, ShortDescription from code_lookup_raw"""

_CLAIMS_FULL = """select s.*, b.* exclude (BeneID), l.PotentialFraud
from claims_src s left join beneficiary b on s.BeneID = b.BeneID left join provider_label l on s.Provider = l.Provider"""

_CLAIMS_DUP = """select * from claims_full union all select * from claims_full where length(AttendingPhysician) = 4"""

_VALID_CLAIMS = """select * from claims_full where ClaimEndDt - ClaimStartDt >= 0"""

_INPATIENT = """select * exclude (Source) from claims_src where Source = 'Inpatient'"""
_OUTPATIENT = """select * exclude (Source, AdmissionDt, DischargeDt, DiagnosisGroupCode, ClmAdmitDiagnosisCode)
from claims_src where Source = 'Outpatient'"""


def fixture_ctes() -> str:
    parts = [
        ("claims_src", _claims_src()),
        ("beneficiary", _beneficiary()),
        ("provider_label", _PROVIDER_LABEL),
        ("code_lookup_raw", _CODE_LOOKUP_RAW),
        ("code_lookup", _CODE_LOOKUP),
        ("claims_full", _CLAIMS_FULL),
        ("claims_dup", _CLAIMS_DUP),
        ("valid_claims", _VALID_CLAIMS),
        ("inpatient", _INPATIENT),
        ("outpatient", _OUTPATIENT),
    ]
    return "with " + ",\n".join(f"{name} as (\n{sql}\n)" for name, sql in parts)


def with_fixture(body: str, extra: list[tuple[str, str]] | None = None) -> str:
    """Prefix ``body`` with the fixture CTEs (and optional extra CTEs)."""
    head = fixture_ctes()
    if extra:
        head += ",\n" + ",\n".join(f"{name} as (\n{sql}\n)" for name, sql in extra)
    stripped = body.lstrip()
    if stripped[:5].lower() == "with ":
        return f"{head},\n{stripped[5:]}"
    return f"{head}\n{body}"
