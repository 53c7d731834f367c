"""Count, rate, distribution, duplicate and top-k reports.

Conventions (pandas semantics the reference relies on):

* group keys that are null are dropped (``value_counts`` / ``groupby``);
* percents are rounded half-to-even (``bround``);
* every top-k has a full tie-break so results are deterministic.

Plan shape: every report is one or two hash aggregations with map-side
partial aggregation, so a hot key (one provider or patient holding a large
share of the claims) is pre-aggregated inside each map task before the
shuffle.  Distinct counts are first deduplicated on (key, value), which
spreads a hot key over its values.  Global totals are scalar subqueries
(one row), never a single-partition window over data-sized input.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimscope.functions.expressions import (
    age_group,
    age_group_order,
    binary_flag,
    count_equal,
    map_values,
    pct,
    strip_affix,
)
from claimscope.functions.values import (
    AGE_LABELS,
    CHRONIC_CONDITIONS,
    DIAGNOSIS_PREFIX,
    LABEL_NO,
    LABEL_YES,
    N_DIAGNOSIS,
    PHYSICIAN_COLS,
    STATE_NAMES,
)
from claimscope.operators.ranking import quantiles, ranked_counts

LABEL = "PotentialFraud"


def _nonnull(*cols: str) -> Column:
    cond = F.lit(True)
    for c in cols:
        cond = cond & F.col(c).isNotNull()
    return cond


def group_counts(df: DataFrame, keys: Sequence[str], name: str = "count") -> DataFrame:
    """``value_counts`` / ``groupby().size()``: rows per key, null keys dropped."""
    return df.where(_nonnull(*keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def diagnosis_cols(n: int = N_DIAGNOSIS) -> list[str]:
    return [f"{DIAGNOSIS_PREFIX}_{i}" for i in range(1, n + 1)]


# A1 / A21
def label_distribution(df: DataFrame, label: str = LABEL, scale: int = 2) -> DataFrame:
    """count, proportion and percent (rounded) per label value; null labels
    are not counted (not in the denominator either)."""
    counts = group_counts(df, [label])
    total = counts.agg(F.sum("count")).scalar()
    share = F.col("count") / total
    return counts.select(label, "count", share.alias("proportion"), F.bround(share * 100, scale).alias("percent"))


def class_balance(df: DataFrame, label: str = "FraudLabel", scale: int = 4) -> DataFrame:
    """Share of each class, rounded to ``scale`` decimals."""
    counts = group_counts(df, [label])
    total = counts.agg(F.sum("count")).scalar()
    return counts.select(label, F.bround(F.col("count") / total, scale).alias("share"))


# O2
def top_k(df: DataFrame, order: Sequence[Column | str], k: int) -> DataFrame:
    """Global top-k (TakeOrderedAndProject: per-partition top-k, then merge)."""
    return df.orderBy(*order).limit(k)


# A2
def claims_per_provider(claims: DataFrame, k: int | None = 15) -> DataFrame:
    counts = group_counts(claims, ["Provider"], "ClaimCount")
    return counts if k is None else top_k(counts, [F.desc("ClaimCount"), F.asc("Provider")], k)


# A3
def top_reimbursed(claims: DataFrame, k: int = 10) -> DataFrame:
    per = claims.where(_nonnull("Provider")).groupBy("Provider").agg(
        F.coalesce(F.sum("InscClaimAmtReimbursed"), F.lit(0)).cast("bigint").alias("TotalReimbursement")
    )
    return top_k(per, [F.desc("TotalReimbursement"), F.asc("Provider")], k)


# J4
def merge_counts(left: DataFrame, right: DataFrame, key: str = "Provider") -> DataFrame:
    """Full outer join of two per-key counts, missing counts as 0."""
    out = left.join(right, on=key, how="full_outer")
    return out.fillna(0, subset=[c for c in out.columns if c != key])


# A4
def claim_volume(claims: DataFrame, k: int | None = 10) -> DataFrame:
    """Inpatient / outpatient / total claims per provider in one pass over
    the tagged claims (equal to J4 over the two claim files)."""
    per = claims.where(_nonnull("Provider")).groupBy("Provider").agg(
        F.count_if(F.col("Source") == "Inpatient").cast("bigint").alias("InpatientClaimCount"),
        F.count_if(F.col("Source") == "Outpatient").cast("bigint").alias("OutpatientClaimCount"),
    )
    per = per.withColumn("TotalClaims", F.col("InpatientClaimCount") + F.col("OutpatientClaimCount"))
    return per if k is None else top_k(per, [F.desc("TotalClaims"), F.asc("Provider")], k)


def claim_volume_two_files(inpatient: DataFrame, outpatient: DataFrame, k: int | None = 10) -> DataFrame:
    """A4 exactly as the reference: count each file, full-outer merge."""
    ip = group_counts(inpatient, ["Provider"], "InpatientClaimCount")
    op = group_counts(outpatient, ["Provider"], "OutpatientClaimCount")
    per = merge_counts(ip, op).withColumn("TotalClaims", F.col("InpatientClaimCount") + F.col("OutpatientClaimCount"))
    return per if k is None else top_k(per, [F.desc("TotalClaims"), F.asc("Provider")], k)


def _long_flags(claims: DataFrame, cols: Sequence[str], ids: Sequence[str], value: str = "flag") -> DataFrame:
    """Wide flag columns -> (ids..., Condition, flag) in one scan."""
    return claims.unpivot(list(ids), list(cols), "Condition", value)


# A5
def chronic_percent(claims: DataFrame, conditions: Sequence[str] = CHRONIC_CONDITIONS) -> DataFrame:
    """Percent of claims with each condition, per label (long form:
    Condition, Fraud, Percent).  Flags 1/2 are remapped to 1/0 first."""
    long = _long_flags(claims.where(_nonnull(LABEL)), conditions, [LABEL])
    long = long.withColumn("flag", binary_flag("flag"))
    return long.groupBy("Condition", F.col(LABEL).alias("Fraud")).agg(
        (F.sum("flag").cast("double") / F.count("flag") * 100).alias("Percent")
    )


# A6
def chronic_mean_raw(claims: DataFrame, conditions: Sequence[str] = CHRONIC_CONDITIONS) -> DataFrame:
    """Mean of the raw 1/2 codes per label; conditions as rows, labels as
    columns (No, Yes)."""
    long = _long_flags(claims.where(_nonnull(LABEL)), conditions, [LABEL])
    return long.groupBy("Condition").pivot(LABEL, [LABEL_NO, LABEL_YES]).agg(
        F.sum("flag").cast("double") / F.count("flag")
    )


# A7
def condition_fraud_stats(claims: DataFrame, conditions: Sequence[str] = CHRONIC_CONDITIONS) -> DataFrame:
    """Per condition, over claims having it (flag = 1): total, Yes and No
    counts, Yes/No percents among labelled claims (0 when absent)."""
    long = _long_flags(claims, conditions, [LABEL]).where(F.col("flag") == 1)
    agg = long.groupBy("Condition").agg(
        F.count(F.lit(1)).alias("TotalWithCondition"),
        F.count_if(F.col(LABEL) == LABEL_YES).cast("bigint").alias("FraudCount"),
        F.count_if(F.col(LABEL) == LABEL_NO).cast("bigint").alias("NoFraudCount"),
    )
    labelled = F.col("FraudCount") + F.col("NoFraudCount")
    return agg.select(
        strip_affix("Condition", prefix="ChronicCond_").alias("Condition"),
        "TotalWithCondition",
        "FraudCount",
        "NoFraudCount",
        F.coalesce(pct("FraudCount", labelled), F.lit(0.0)).alias("PctFraud"),
        F.coalesce(pct("NoFraudCount", labelled), F.lit(0.0)).alias("PctNoFraud"),
    )


# A8
def condition_fraud_long(claims: DataFrame, conditions: Sequence[str] = CHRONIC_CONDITIONS) -> DataFrame:
    """Unrounded Yes/No percents per condition in long form
    (Condition, FraudStatus, Percentage)."""
    long = _long_flags(claims, conditions, [LABEL]).where(F.col("flag") == 1)
    agg = long.groupBy("Condition").agg(
        F.count_if(F.col(LABEL) == LABEL_YES).alias("y"),
        F.count_if(F.col(LABEL) == LABEL_NO).alias("n"),
    )
    labelled = F.col("y") + F.col("n")
    wide = agg.select(
        strip_affix("Condition", prefix="ChronicCond_").alias("Condition"),
        F.coalesce(F.try_divide(F.col("y"), labelled) * 100, F.lit(0.0)).alias("Fraud_Yes_%"),
        F.coalesce(F.try_divide(F.col("n"), labelled) * 100, F.lit(0.0)).alias("Fraud_No_%"),
    )
    melted = wide.unpivot(["Condition"], ["Fraud_Yes_%", "Fraud_No_%"], "FraudStatus", "Percentage")
    return melted.withColumn("FraudStatus", strip_affix("FraudStatus", prefix="Fraud_", suffix="_%"))


# A9
def describe_by(df: DataFrame, key: str, value: str) -> DataFrame:
    """count, mean, sample std, min, 25/50/75 % (linear interpolation), max of
    ``value`` per ``key`` (null keys dropped, null values ignored), all from
    the counts of distinct values, ranked by range: one read of ``df``, and no
    label's values in one task."""
    ranks = ranked_counts(df.where(_nonnull(key)), key, value)
    v, n = F.col("value"), F.when(F.col("value").isNotNull(), F.col("n"))
    base = ranks.groupBy("key").agg(
        F.coalesce(F.sum(n), F.lit(0)).alias("count"),
        F.try_divide(F.sum(v * n).cast("double"), F.sum(n)).alias("mean"),
        F.min(v).cast("double").alias("min"), F.max(v).cast("double").alias("max"),
    )
    gap = v.cast("double") - F.col("mean")
    spread = ranks.join(base.select("key", "mean"), "key").groupBy("key").agg(F.sum(n * gap * gap).alias("_ss"))
    out = base.join(spread, "key").join(quantiles(ranks, [0.25, 0.5, 0.75]), "key")
    return out.select(
        F.col("key").alias(key), "count", "mean",
        F.sqrt(F.when(F.col("count") > 1, F.col("_ss") / (F.col("count") - 1))).alias("std"), "min",
        F.col("q0").alias("p25"), F.col("q1").alias("p50"), F.col("q2").alias("p75"), "max",
    )


# J5
def with_provider_label(df: DataFrame, claims: DataFrame) -> DataFrame:
    """Attach the label through the distinct (Provider, label) pairs."""
    pairs = claims.select("Provider", LABEL).distinct()
    return df.join(pairs, on="Provider", how="left")


# U2 + A10
def physicians_per_provider(claims: DataFrame) -> DataFrame:
    """Distinct physicians per provider over the three physician columns."""
    long = claims.select(
        "Provider", F.explode(F.array(*[F.col(c) for c in PHYSICIAN_COLS])).alias("Physician")
    ).where(_nonnull("Provider", "Physician"))
    counts = long.groupBy("Provider").agg(F.count_distinct("Physician").alias("NumUniquePhysicians"))
    return with_provider_label(counts, claims)


# A11
def claims_per_patient(claims: DataFrame) -> DataFrame:
    return group_counts(claims, ["BeneID", LABEL], "ClaimCount")


def claims_per_provider_labelled(claims: DataFrame) -> DataFrame:
    """Claims per provider with the provider's label (input of A9/A24)."""
    return with_provider_label(group_counts(claims, ["Provider"], "NumClaims"), claims)


def patient_profile(claims: DataFrame) -> DataFrame:
    """One row per patient: distinct providers (shared by A12-A15, A20)."""
    return claims.where(_nonnull("BeneID")).groupBy("BeneID").agg(
        F.count_distinct("Provider").alias("NumProviders")
    )


# A12
def providers_seen_hist(claims: DataFrame) -> DataFrame:
    prof = patient_profile(claims)
    return prof.groupBy(F.col("NumProviders").alias("NumProvidersSeen")).agg(
        F.count(F.lit(1)).alias("NumPatients")
    )


# A13 (W4)
def providers_per_patient(claims: DataFrame) -> DataFrame:
    """Distinct providers per patient and ONE label per patient: the label of
    the patient's first claim by (ClaimStartDt, ClaimID, Provider).  The
    reference takes the first pair in load order; this fixes that order."""
    order = F.struct("ClaimStartDt", "ClaimID", "Provider")
    return claims.where(_nonnull("BeneID")).groupBy("BeneID").agg(
        F.count_distinct("Provider").alias("ProviderCount"),
        F.min_by(F.col(LABEL), order).alias(LABEL),
    )


# A14
def suspicious_patients(claims: DataFrame, min_providers: int = 10, k: int | None = 10) -> DataFrame:
    """Patients seeing more than ``min_providers`` providers with the share
    (a fraction, not a percent) of their labelled claims per label."""
    agg = claims.where(_nonnull("BeneID")).groupBy("BeneID").agg(
        F.count_distinct("Provider").alias("NumProviders"),
        F.count(LABEL).alias("_n"),
        F.count_if(F.col(LABEL) == LABEL_NO).alias("_no"),
        F.count_if(F.col(LABEL) == LABEL_YES).alias("_yes"),
    ).where(F.col("NumProviders") > min_providers)
    out = agg.select(
        "BeneID", "NumProviders",
        F.try_divide(F.col("_no"), F.col("_n")).alias("share_no"),
        F.try_divide(F.col("_yes"), F.col("_n")).alias("share_yes"),
    )
    return out if k is None else top_k(out, [F.desc("NumProviders"), F.asc("BeneID")], k)


# A15
def high_provider_summary(claims: DataFrame, min_providers: int = 15, k: int | None = 10) -> DataFrame:
    """Patients seeing at least ``min_providers`` providers: distinct claims,
    distinct providers, mean chronic-condition count per claim and percent of
    claims labelled Yes (null label counts as not Yes).  One aggregation: the
    provider count over all a patient's claims is the filter, so no
    semi-join back to the claims is needed."""
    chronic = count_equal(CHRONIC_CONDITIONS, 1)
    agg = claims.where(_nonnull("BeneID")).groupBy("BeneID").agg(
        F.count_distinct("ClaimID").alias("NumClaims"),
        F.count_distinct("Provider").alias("NumProviders"),
        (F.sum(chronic).cast("double") / F.count(F.lit(1))).alias("AvgChronicConditions"),
        (F.count_if(F.col(LABEL) == LABEL_YES) / F.count(F.lit(1)) * 100).alias("PercentFraud"),
    ).where(F.col("NumProviders") >= min_providers)
    return agg if k is None else top_k(agg, [F.desc("PercentFraud"), F.asc("BeneID")], k)


# A16 (U7)
def fraud_rate_by(df: DataFrame, dim: str | Column, name: str | None = None) -> DataFrame:
    """Two-way table dim x label with Total and % Fraud (rounded 2)."""
    d = F.col(dim) if isinstance(dim, str) else dim
    name = name or (dim if isinstance(dim, str) else "dim")
    base = df.select(d.alias(name), F.col(LABEL)).where(_nonnull(name, LABEL))
    wide = base.groupBy(name).agg(
        F.count_if(F.col(LABEL) == LABEL_NO).alias(LABEL_NO),
        F.count_if(F.col(LABEL) == LABEL_YES).alias(LABEL_YES),
    )
    total = F.col(LABEL_NO) + F.col(LABEL_YES)
    return wide.select(name, LABEL_NO, LABEL_YES, total.alias("Total"), pct(LABEL_YES, total).alias("PctFraud"))


def fraud_rate_by_age_group(claims: DataFrame, age: Column) -> DataFrame:
    """A16 over the age bins; empty bins are kept with zero counts and a
    null percent (categorical grouping)."""
    rates = fraud_rate_by(claims, age_group(age), "AgeGroup")
    bins = claims.sparkSession.createDataFrame([(lbl, i) for i, lbl in enumerate(AGE_LABELS)], "AgeGroup string, ord int")
    # the bin table has a fixed size (8 rows): broadcasting it is bounded
    out = F.broadcast(bins).join(rates, on="AgeGroup", how="left")
    return out.select(
        "AgeGroup",
        F.coalesce(F.col(LABEL_NO), F.lit(0)).cast("bigint").alias(LABEL_NO),
        F.coalesce(F.col(LABEL_YES), F.lit(0)).cast("bigint").alias(LABEL_YES),
        F.coalesce(F.col("Total"), F.lit(0)).cast("bigint").alias("Total"),
        "PctFraud",
    )


# A17
def top_states(claims: DataFrame, k: int | None = 10) -> DataFrame:
    """A16 by state code with the state name (null for unknown codes),
    sorted by % Fraud."""
    rates = fraud_rate_by(claims, "State")
    out = rates.select(map_values("State", STATE_NAMES).alias("StateName"), *rates.columns)
    return out if k is None else top_k(out, [F.desc_nulls_last("PctFraud"), F.asc("State")], k)


# A18
def duplicate_count(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows repeating an earlier row on ``keys`` (null equals null):
    rows - distinct key combinations, via one partial aggregation."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("n_duplicates"),
        F.count_if(F.col("n") > 1).cast("bigint").alias("n_groups"),
    )


# A19
def duplicate_label_split(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Label counts among ALL members of duplicated key groups, with percents
    whose denominator includes unlabelled members.  Grouped, not windowed:
    a huge duplicate group is still pre-aggregated per map task."""
    groups = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col(LABEL) == LABEL_YES).alias("y"),
        F.count_if(F.col(LABEL) == LABEL_NO).alias("no"),
    ).where(F.col("n") > 1)
    tot = groups.agg(F.sum("n").alias("members"), F.sum("y").alias("y"), F.sum("no").alias("no"))
    long = tot.select(
        "members",
        F.explode(F.array(
            F.struct(F.lit(LABEL_NO).alias(LABEL), F.col("no").alias("count")),
            F.struct(F.lit(LABEL_YES).alias(LABEL), F.col("y").alias("count")),
        )).alias("s"),
    ).select(F.col(f"s.{LABEL}").alias(LABEL), F.col("s.count").cast("bigint").alias("count"), "members")
    return long.where(F.col("count") > 0).select(LABEL, "count", pct("count", "members").alias("percent"))


# A20
def max_providers(claims: DataFrame) -> DataFrame:
    return patient_profile(claims).agg(F.max("NumProviders").alias("max_providers"))


# A22 (J3, P9)
def top_codes(claims: DataFrame, lookup: DataFrame, k: int = 10, cols: Sequence[str] | None = None) -> DataFrame:
    """Most frequent codes over the diagnosis columns with descriptions."""
    cols = list(cols or diagnosis_cols())
    codes = claims.select(F.explode(F.array(*[F.col(c).cast("string") for c in cols])).alias("DiagnosisCode"))
    counts = group_counts(codes, ["DiagnosisCode"], "Count")
    top = top_k(counts, [F.desc("Count"), F.asc("DiagnosisCode")], k)
    described = top.join(lookup, top.DiagnosisCode == lookup.Code, "left")
    return described.select(
        "DiagnosisCode", "Count", "LongDescription", "ShortDescription",
        F.coalesce("ShortDescription", "DiagnosisCode").alias("Label"),
    )


# A23 (W2)
def top_codes_by_label(claims: DataFrame, k: int = 10, cols: Sequence[str] | None = None) -> DataFrame:
    from claimscope.operators.windows import top_k_per_group

    cols = list(cols or diagnosis_cols())
    long = claims.select(LABEL, F.explode(F.array(*[F.col(c) for c in cols])).alias("DiagCode"))
    counts = group_counts(long, [LABEL, "DiagCode"], "Count")
    return top_k_per_group(counts, [LABEL], [F.desc("Count"), F.asc("DiagCode")], k)


# A27
def count_by(df: DataFrame, dim: str | Column, name: str | None = None) -> DataFrame:
    d = F.col(dim) if isinstance(dim, str) else dim
    name = name or (dim if isinstance(dim, str) else "dim")
    return group_counts(df.select(d.alias(name), LABEL), [name, LABEL])


__all__ = [n for n in dir() if not n.startswith("_")] + ["age_group_order"]
