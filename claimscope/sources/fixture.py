"""Mapping of the driver's TPC-H-style parquet tables onto the claim data model.

The reference reads four external claim files; the test tables are mapped onto
the same columns by fixed rules so that every operator can be checked.  The
rules are those agreed in FIXTURES.md and are mirrored, as SQL text, by
``claimscope.plans.fixture_sql`` for the DuckDB twin.

All readers return lazy DataFrames (the claims' join only counts its rows beforehand): Catalyst prunes each scan to the columns a
report uses and pushes filters into the parquet reader.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimscope.functions.values import CHRONIC_CONDITIONS, N_DIAGNOSIS, N_PROCEDURE

#: Rows of line items and orders together that one task of their join takes.
PART_ROWS = 250_000


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _id(prefix: str, key: Column) -> Column:
    return F.concat(F.lit(prefix), key.cast("string"))


def _dealt(left: DataFrame, left_key: str, right: DataFrame, right_key: str) -> tuple[DataFrame, DataFrame]:
    """Both tables dealt by the key of their join, ``PART_ROWS`` rows of the two a task.

    Spark raises the number to its own of shuffle partitions.  Where that would leave under a quarter of the rows to
    a task, or keep no more tasks busy than there are cores, Spark chooses by itself.  With more rows it would put
    neighbouring parts together up to 64 packed MB, or broadcast a table whose file is packed well, so what one task
    holds would grow with the tables.  The rows are counted from the files' footers."""
    spark = left.sparkSession
    number = -(-left.select(F.lit(1)).unionAll(right.select(F.lit(1))).count() // PART_ROWS)
    own = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if number <= max(spark.sparkContext.defaultParallelism, own // 4):
        return left.repartition(left_key), right
    return left.repartition(number, left_key), right.repartition(number, right_key).hint("merge")


def claims_src(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One claim per line item (``lineitem`` joined to ``orders``)."""
    li = _table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_returnflag", "l_shipdate"
    )
    od = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    # dealt by the key that the join needs: the same shuffle as a sort-merge join's own, and a file with a single
    # row group does not keep all later work in one task
    li, od = _dealt(li, "l_orderkey", od, "o_orderkey")
    j = li.join(od, li.l_orderkey == od.o_orderkey)

    pk = F.col("l_partkey")
    ln = F.col("l_linenumber")
    inpatient = F.col("l_returnflag") == "A"
    start = F.col("l_shipdate").cast("date")
    end = F.date_add(start, ((pk * 7 + ln) % 25 - 2).cast("int"))

    cols = [
        F.concat(F.lit("CLM"), F.col("l_orderkey").cast("string"), F.lit("_"), ln.cast("string")).alias("ClaimID"),
        _id("BENE", F.col("o_custkey")).alias("BeneID"),
        _id("PRV", F.col("l_suppkey")).alias("Provider"),
        start.alias("ClaimStartDt"),
        end.alias("ClaimEndDt"),
        F.when(pk % 20 == 0, F.lit(0).cast("bigint"))
        .otherwise(F.floor("l_extendedprice").cast("bigint"))
        .alias("InscClaimAmtReimbursed"),
        F.when(ln == 5, F.lit(None).cast("bigint")).otherwise(((pk % 9) * 100).cast("bigint")).alias("DeductibleAmtPaid"),
        F.when(pk % 50 == 0, F.lit(None).cast("string")).otherwise(_id("PHY", pk % 400)).alias("AttendingPhysician"),
        F.when(pk % 4 == 0, _id("PHY", (pk * 3) % 400)).alias("OperatingPhysician"),
        F.when(pk % 3 == 0, _id("PHY", (pk * 7) % 400)).alias("OtherPhysician"),
        F.when(inpatient, start).alias("AdmissionDt"),
        F.when(inpatient, end).alias("DischargeDt"),
        F.when(inpatient, (100 + pk % 60).cast("string")).alias("ClmAdmitDiagnosisCode"),
        F.when(inpatient, (pk % 300).cast("string")).alias("DiagnosisGroupCode"),
        F.when(inpatient, F.lit("Inpatient")).otherwise(F.lit("Outpatient")).alias("Source"),
    ]
    for i in range(1, N_DIAGNOSIS + 1):
        cols.append(
            F.when(F.lit(i) <= 1 + pk % 10, (100 + (pk * i + ln) % 60).cast("string")).alias(f"ClmDiagnosisCode_{i}")
        )
    for i in range(1, N_PROCEDURE + 1):
        cols.append(
            F.when(inpatient & (F.lit(i) <= pk % 4), (3000 + (pk * i) % 40).cast("int")).alias(f"ClmProcedureCode_{i}")
        )
    return j.select(*cols)


def beneficiary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per patient (from ``customer``)."""
    c = _table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    k = F.col("c_custkey")
    cols = [
        _id("BENE", k).alias("BeneID"),
        F.date_add(F.lit("1909-01-01").cast("date"), ((k * 37) % 27000).cast("int")).alias("DOB"),
        F.when(k % 120 == 0, F.lit("2009-12-01").cast("date")).alias("DOD"),
        (1 + k % 2).cast("int").alias("Gender"),
        F.when(k % 97 == 0, 4).when(k % 5 == 1, 2).when(k % 5 == 2, 3).when(k % 5 == 3, 5).otherwise(1)
        .cast("int").alias("Race"),
        F.when(k % 7 == 0, F.lit("Y")).otherwise(F.lit("0")).alias("RenalDiseaseIndicator"),
        (1 + k % 54).cast("int").alias("State"),
        (k % 200).cast("int").alias("County"),
    ]
    for j, name in enumerate(CHRONIC_CONDITIONS, start=1):
        cols.append(F.when((k * j + j * j) % (j + 2) == 0, 1).otherwise(2).cast("int").alias(name))
    bal = F.abs(F.col("c_acctbal"))
    cols += [
        F.floor(bal).cast("bigint").alias("IPAnnualReimbursementAmt"),
        (k % 11 * 100).cast("bigint").alias("IPAnnualDeductibleAmt"),
        F.floor(bal * 0.25).cast("bigint").alias("OPAnnualReimbursementAmt"),
        (k % 13 * 50).cast("bigint").alias("OPAnnualDeductibleAmt"),
    ]
    return c.select(*cols)


def provider_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provider fraud labels (from ``supplier``); some providers have none."""
    s = _table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal")
    return s.where(F.col("s_suppkey") % 33 != 5).select(
        _id("PRV", F.col("s_suppkey")).alias("Provider"),
        F.when(F.col("s_acctbal") < 2000, F.lit("Yes")).otherwise(F.lit("No")).alias("PotentialFraud"),
    )


def code_lookup_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uncleaned diagnosis-code lookup (codes padded with blanks and a dot)."""
    p = _table(spark, sf_dir, "part").select("p_size")
    s = (F.lit(99) + F.col("p_size")).cast("string")
    return p.select(
        F.concat(F.lit(" "), F.substring(s, 1, 2), F.lit("."), F.substring(s, 3, 1), F.lit(" ")).alias("Code"),
        F.concat(F.lit("Long "), F.col("p_size").cast("string")).alias("LongDescription"),
        F.when(F.col("p_size") % 10 == 0, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("Short "), F.col("p_size").cast("string")))
        .alias("ShortDescription"),
    ).distinct()


def inpatient_outpatient(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The two claim files the reference reads: split by source; the
    outpatient part lacks the inpatient-only columns; neither has ``Source``."""
    src = claims_src(spark, sf_dir)
    ip = src.where(F.col("Source") == "Inpatient").drop("Source")
    op = src.where(F.col("Source") == "Outpatient").drop(
        "Source", "AdmissionDt", "DischargeDt", "DiagnosisGroupCode", "ClmAdmitDiagnosisCode"
    )
    return ip, op


def roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provider roster: the distinct providers of the claims."""
    return claims_src(spark, sf_dir).select("Provider").distinct()


def claims_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``claims_src`` ⟕ beneficiary ⟕ provider label (54 columns)."""
    from claimscope.operators.claims import claims_full as _full

    return _full(claims_src(spark, sf_dir), beneficiary(spark, sf_dir), provider_label(spark, sf_dir))


PATIENT, LABEL = "patient", "label"


def claims_with(spark: SparkSession, sf_dir: str, *sides: str) -> DataFrame:
    """``claims_src`` with the columns of the named sides only (``PATIENT``, ``LABEL``).

    Catalyst keeps a left join to a side that it does not know to be unique,
    so a report asks for just the sides whose columns it reads."""
    from claimscope.operators.claims import attach_beneficiary, attach_label

    out = claims_src(spark, sf_dir)
    if PATIENT in sides:
        out = attach_beneficiary(out, beneficiary(spark, sf_dir))
    if LABEL in sides:
        out = attach_label(out, provider_label(spark, sf_dir))
    return out


def with_second_copies(claims: DataFrame) -> DataFrame:
    """The claims plus a second copy of the rows whose attending physician id
    has length 4 (for the duplicate operators)."""
    return claims.unionByName(claims.where(F.length("AttendingPhysician") == 4))


def claims_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_second_copies(claims_full(spark, sf_dir))


def code_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned code lookup: ``Code`` trimmed and without dots."""
    from claimscope.sources.readers import clean_code_lookup

    return clean_code_lookup(code_lookup_raw(spark, sf_dir))
