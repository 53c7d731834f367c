"""Feature tables, splits and encodings for the models (M1-M6, M13 folds).

Every feature table keeps ``RowID`` (a content hash of the claim, W6) as a
non-feature key so splits, predictions, contributions and topic vectors can
be joined back by key, never by position.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimscope.functions import expressions as X
from claimscope.functions.values import (
    AGE_LABELS,
    CHRONIC_CONDITIONS,
    DROP_B,
    DROP_B_LATER,
    DROP_C,
    FEATURES_D,
    HIGH_MISSING_THRESHOLD,
    NON_PREDICTIVE_A,
    RACE_NAMES,
    SEED,
    SOURCE_CODES,
)
from claimscope.operators import cleanup
from claimscope.operators.ranking import hash_cut, hash_rank, seeded_hash
from claimscope.operators.windows import with_row_id
from claimscope.session import saved

LABEL = "FraudLabel"
#: All columns of a claim; patient and label columns follow from them.
ROW_ID_COLS = (
    ["ClaimID", "BeneID", "Provider", "ClaimStartDt", "ClaimEndDt", "InscClaimAmtReimbursed", "DeductibleAmtPaid",
     "AttendingPhysician", "OperatingPhysician", "OtherPhysician", "AdmissionDt", "DischargeDt",
     "ClmAdmitDiagnosisCode", "DiagnosisGroupCode", "Source"]
    + [f"ClmDiagnosisCode_{i}" for i in range(1, 11)] + [f"ClmProcedureCode_{i}" for i in range(1, 7)]
)


def diag_cols(df: DataFrame) -> list[str]:
    return [c for c in cleanup.cols_with_prefix(df, "ClmDiagnosisCode") if not c.endswith("_Named")]


def proc_cols(df: DataFrame) -> list[str]:
    return cleanup.cols_with_prefix(df, "ClmProcedureCode")


def with_claim_row_id(claims: DataFrame) -> DataFrame:
    """Claims keyed by RowID; claims that have one are returned as they are."""
    return claims if "RowID" in claims.columns else with_row_id(claims, ROW_ID_COLS)


def enriched_claims(valid_claims: DataFrame) -> DataFrame:
    """The claim table as the reference has it when modelling starts: stay
    filter applied upstream, plus LogReimbursed, LengthOfStay, Age (by year),
    AgeGroup, Race as names, RowID."""
    c = with_claim_row_id(valid_claims)
    return c.withColumns({
        "LogReimbursed": X.log_reimbursed(),
        "LengthOfStay": X.days_between("ClaimEndDt", "ClaimStartDt"),
        "Age": X.age_by_year("DOB"),
        "AgeGroup": X.age_group(X.age_by_year("DOB")),
        "Race": X.map_values("Race", RACE_NAMES),
    })


# M1
def features_a(enriched: DataFrame) -> DataFrame:
    """Drop ids / dates / procedures, drop text columns except AgeGroup (a
    category), label Yes/No -> 1/0, drop rows with any null."""
    df = enriched.withColumn(LABEL, X.label_code("PotentialFraud"))
    df = cleanup.drop_cols(df, [c for c in NON_PREDICTIVE_A] + proc_cols(df))
    df = cleanup.drop_string_cols(df, keep=["AgeGroup", "RowID"])
    return cleanup.dropna_any(df, [c for c in df.columns if c != "RowID"])


# M2
def features_b(claims: DataFrame) -> DataFrame:
    """Drop ids, force every column numeric (bad -> null -> 0); label kept
    separately (null for unlabelled claims)."""
    df = with_claim_row_id(claims).withColumn(LABEL, X.label_code("PotentialFraud"))
    df = cleanup.drop_cols(df, DROP_B + ["PotentialFraud"] + DROP_B_LATER)
    feats = [c for c in df.columns if c not in ("RowID", LABEL)]
    return cleanup.to_numeric_lenient(df, feats, fill=0.0)


# M3
def features_c_raw(claims: DataFrame) -> DataFrame:
    """Engineered columns of variant C before column pruning / imputation."""
    dc, pc = diag_cols(claims), proc_cols(claims)
    df = with_claim_row_id(claims).withColumns({
        "Age": X.age_by_days(X.parse_date(F.col("DOB").cast("string"), lenient=True)),
        "RenalDiseaseIndicator": X.map_values("RenalDiseaseIndicator", {"Y": 1}, default=0).cast("int"),
        "Num_ChronicCond_2": X.count_equal(CHRONIC_CONDITIONS, 2),
        "Source": X.map_values("Source", SOURCE_CODES),
        "TotalClaimAmt": F.col("InscClaimAmtReimbursed") + F.col("DeductibleAmtPaid"),
        "ReimbursedRatio": X.reimbursed_ratio(),
        "ClaimDuration": X.days_between("ClaimEndDt", "ClaimStartDt"),
        "num_diagnosis_codes": X.count_not_null(dc),
        "num_procedure_codes": X.count_not_null(pc),
    })
    df = df.drop(*CHRONIC_CONDITIONS)
    return cleanup.drop_cols(df, DROP_C + dc + pc)


def features_c(claims: DataFrame, threshold: float = HIGH_MISSING_THRESHOLD) -> DataFrame:
    """Variant C: engineered features, single-valued and mostly-missing
    columns dropped (one statistics row each), then mean / mode imputation
    (one statistics row).  Label 0/1 kept separately.  The engineered rows are
    written once to the shared folder, which the four passes then read."""
    df = saved(features_c_raw(claims))
    cand = [c for c in df.columns if c != "RowID"]
    df = df.drop(*cleanup.single_valued_cols(df, cand))
    cand = [c for c in df.columns if c != "RowID"]
    df = df.drop(*cleanup.high_missing_cols(df, threshold, cand))
    df = df.withColumn(LABEL, X.label_code("PotentialFraud")).drop("PotentialFraud")
    feats = [c for c in df.columns if c not in ("RowID", LABEL)]
    return cleanup.impute_mean_mode(df, feats)


# M4
def features_d(enriched: DataFrame, topics: DataFrame | None = None) -> DataFrame:
    """Variant D: 22 named columns (+ topic columns joined by RowID), label,
    rows with nulls dropped, DiagnosisGroupCode -> category code."""
    cols = ["RowID", *FEATURES_D, LABEL]
    df = enriched.withColumn(LABEL, X.label_code("PotentialFraud"))
    if topics is not None:
        df = cleanup.join_on_row_id(df, topics)
        cols += [c for c in topics.columns if c != "RowID"]
    df = cleanup.dropna_any(df.select(*cols), [c for c in cols if c != "RowID"])
    return cleanup.category_codes(df, "DiagnosisGroupCode")


# M5
def stratified_split(df: DataFrame, label: str = LABEL, test_pct: int = 20, seed: int = SEED,
                     key: str = "RowID", group_col: str | None = None) -> DataFrame:
    """Adds ``is_test``: per class, the ceil(test_pct % of the class) rows
    first in md5(seed | key) order.  ``key`` is unique, so class shares are
    exact; distributed (see ``ranking.hash_cut``).  The rows are written once
    to the shared folder, so pass only the columns needed.  ``group_col`` (e.g. Provider) keeps every group
    on one side by hashing the group instead of the row."""
    if group_col:
        groups = df.select(label, group_col).distinct().withColumn("_h", seeded_hash([group_col], seed))
        ranked = hash_rank(groups, [label], "_h", "_rank", size_col="_n")
        cut = F.floor((F.col("_n") * test_pct + 99) / 100)
        flags = ranked.select(label, group_col, (F.col("_rank") <= cut).alias("is_test"))
        return df.join(flags, on=[label, group_col], how="left")
    # the rows are worked out once; the hash at the cut of each class then tells the rest, one row a class
    hashed = saved(df.withColumn("_h", seeded_hash([key], seed)))
    last = hash_cut(hashed, label, "_h", F.floor((F.col("_n") * test_pct + 99) / 100))
    last = last.select(F.col(label).alias("_class"), F.col("_h").alias("_last")).checkpoint()
    joined = hashed.join(F.broadcast(last), F.col(label).eqNullSafe(F.col("_class")), "left")
    return joined.withColumn("is_test", F.coalesce(F.col("_h") <= F.col("_last"), F.lit(False))).drop("_h", "_class", "_last")


# M13 folds
def stratified_folds(df: DataFrame, label: str = LABEL, k: int = 5, seed: int = SEED, key: str = "RowID") -> DataFrame:
    """Adds ``fold`` in 0..k-1: rank within class (seeded hash order) mod k,
    so every fold gets the same share of each class (within one row)."""
    rows = saved(df.withColumn("_h", seeded_hash([key], seed)))
    ranked = hash_rank(rows.select(F.col(key).alias("_key"), label, "_h"), [label], "_h", "_rank")
    fold = F.pmod(F.col("_rank") - 1, F.lit(k)).cast("int").alias("fold")
    folds = ranked.select("_key", fold)
    return rows.drop("_h").join(folds, F.col(key) == F.col("_key")).drop("_key")


# M6
def one_hot(train: DataFrame, val: DataFrame, col: str, levels: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Dummy columns for every level but the first; levels come from the
    training part (or are given, e.g. a category list), so the validation
    part gets the same columns (unseen level -> all zeros)."""
    if levels is None:
        levels = [r[0] for r in train.select(col).where(F.col(col).isNotNull()).distinct().orderBy(col).collect()]
    keep = list(levels)[1:]

    def enc(df: DataFrame) -> DataFrame:
        dummies = {f"{col}_{lv}": (F.col(col) == lv).cast("int") for lv in keep}
        return df.withColumns({k: F.coalesce(v, F.lit(0)) for k, v in dummies.items()}).drop(col)

    return enc(train), enc(val)


AGE_CATEGORIES = AGE_LABELS
