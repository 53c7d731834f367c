"""Building the claim-level table (U1, P1, J1, J2) and claim-level cleanups.

``claims_full`` = (inpatient ∪ outpatient, tagged with their source)
⟕ beneficiary on BeneID ⟕ provider label on Provider; one row per claim.

Join strategy: both right sides are dimension tables keyed by their id.  No
broadcast hint is given: Spark's planner broadcasts a side only when its
measured/estimated size is under ``spark.sql.autoBroadcastJoinThreshold`` (and
AQE re-checks at run time); otherwise it sort-merge joins, which scales with
the data.  The claim side is never broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimscope.functions.expressions import days_between
from claimscope.functions.values import SOURCE_INPATIENT, SOURCE_OUTPATIENT


# P1
def with_source(df: DataFrame, name: str) -> DataFrame:
    """Tag every row with a literal ``Source``."""
    return df.withColumn("Source", F.lit(name))


# U1
def union_claims(inpatient: DataFrame, outpatient: DataFrame) -> DataFrame:
    """Stack the two claim kinds by column name; missing columns become null."""
    return with_source(inpatient, SOURCE_INPATIENT).unionByName(
        with_source(outpatient, SOURCE_OUTPATIENT), allowMissingColumns=True
    )


# J1
def attach_beneficiary(claims: DataFrame, beneficiary: DataFrame) -> DataFrame:
    return claims.join(beneficiary, on="BeneID", how="left")


# J2
def attach_label(claims: DataFrame, labels: DataFrame) -> DataFrame:
    return claims.join(labels.select("Provider", "PotentialFraud"), on="Provider", how="left")


def claims_full(claims: DataFrame, beneficiary: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per claim with patient attributes and the provider label."""
    out = attach_label(attach_beneficiary(claims, beneficiary), labels)
    return out.select(*claims.columns, *[c for c in beneficiary.columns if c != "BeneID"], "PotentialFraud")


def with_length_of_stay(claims: DataFrame) -> DataFrame:
    """Adds ``LengthOfStay`` = end - start in days."""
    return claims.withColumn("LengthOfStay", days_between("ClaimEndDt", "ClaimStartDt"))


def valid_stay(claims: DataFrame) -> DataFrame:
    """Claims with a non-negative stay (the reference removes the others for
    every later report)."""
    return claims.where(days_between("ClaimEndDt", "ClaimStartDt") >= 0)
