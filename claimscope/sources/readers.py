"""Readers and writers for the reference's file formats.

Explicit schemas are the default: schema inference costs an extra pass over
the data and can change types between files.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimscope.functions.expressions import clean_code
from claimscope.functions.values import CHRONIC_CONDITIONS, N_DIAGNOSIS, N_PROCEDURE

S = T.StringType()
D = T.DateType()
I = T.IntegerType()
L = T.LongType()


def _struct(fields: list[tuple[str, T.DataType]]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


LABEL_SCHEMA = _struct([("Provider", S), ("PotentialFraud", S)])
ROSTER_SCHEMA = _struct([("Provider", S)])
BENEFICIARY_SCHEMA = _struct(
    [("BeneID", S), ("DOB", D), ("DOD", D), ("Gender", I), ("Race", I), ("RenalDiseaseIndicator", S),
     ("State", I), ("County", I)]
    + [(c, I) for c in CHRONIC_CONDITIONS]
    + [("IPAnnualReimbursementAmt", L), ("IPAnnualDeductibleAmt", L),
       ("OPAnnualReimbursementAmt", L), ("OPAnnualDeductibleAmt", L)]
)
_CLAIM_HEAD = [
    ("BeneID", S), ("ClaimID", S), ("ClaimStartDt", D), ("ClaimEndDt", D), ("Provider", S),
    ("InscClaimAmtReimbursed", L), ("AttendingPhysician", S), ("OperatingPhysician", S), ("OtherPhysician", S),
]
_CODES = [(f"ClmDiagnosisCode_{i}", S) for i in range(1, N_DIAGNOSIS + 1)] + [
    (f"ClmProcedureCode_{i}", I) for i in range(1, N_PROCEDURE + 1)
]
INPATIENT_SCHEMA = _struct(
    _CLAIM_HEAD[:5] + [("InscClaimAmtReimbursed", L), ("AttendingPhysician", S), ("OperatingPhysician", S),
                       ("OtherPhysician", S), ("AdmissionDt", D), ("ClmAdmitDiagnosisCode", S),
                       ("DeductibleAmtPaid", L), ("DischargeDt", D), ("DiagnosisGroupCode", S)]
    + _CODES
)
OUTPATIENT_SCHEMA = _struct(_CLAIM_HEAD + _CODES + [("DeductibleAmtPaid", L), ("ClmAdmitDiagnosisCode", S)])
CODE_LOOKUP_SCHEMA = _struct([("Code", S), ("LongDescription", S), ("ShortDescription", S), ("Extra", S)])


# S1 / S8
def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None, **options) -> DataFrame:
    """CSV with a header row.  With a schema no inference pass is made."""
    reader = spark.read.option("header", "true")
    for k, v in options.items():
        reader = reader.option(k, v)
    if schema is not None:
        return reader.schema(schema).csv(path)
    return reader.option("inferSchema", "true").csv(path)


def read_roster(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, ROSTER_SCHEMA)


# S2
def read_claims_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Wide claims CSV; inference only when no schema is given."""
    return read_csv(spark, path, schema)


# S3
def read_code_lookup(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated, ISO-8859-1 lookup with a header; first three columns,
    renamed, code cleaned."""
    raw = (
        spark.read.option("header", "true").option("sep", "\t").option("encoding", "ISO-8859-1")
        .schema(CODE_LOOKUP_SCHEMA).csv(path)
    )
    return clean_code_lookup(raw.select(raw.columns[:3]).toDF("Code", "LongDescription", "ShortDescription"))


def clean_code_lookup(df: DataFrame) -> DataFrame:
    return df.withColumn("Code", clean_code("Code"))


# S4
def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Header CSV, no index column; one file per partition (no coalesce to one
    task)."""
    df.write.mode(mode).option("header", "true").csv(path)


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite", partition_by: list[str] | None = None) -> None:
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


# S5
def table_shapes(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table, n_rows, n_cols) for each table: one count job per table,
    unioned into one result."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(name).alias("table"), "n_rows", F.lit(len(df.columns)).cast("int").alias("n_cols")
        )
        for name, df in tables.items()
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# S6
def head(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """First ``n`` rows in a stated order (top-k, not a full sort)."""
    return df.orderBy(*order).limit(n)


# S7
def columns(df: DataFrame) -> DataFrame:
    """Schema profile: position, name and type of every column."""
    spark = df.sparkSession
    rows = [(i, n, t) for i, (n, t) in enumerate(df.dtypes, start=1)]
    return spark.createDataFrame(rows, "position int, column string, type string")
