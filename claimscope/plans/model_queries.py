"""Registered feature / model / metric / explanation queries.

Exact parts (feature tables, split, encodings, metrics on a fixed rule score,
TF-IDF, explanation text on fixed contributions) have SQL twins; trained
models, SVD topics and SMOTE are checked rows-only here and by unit tests
(properties) in ``tests/``.  Sums that a fitted model must satisfy (importances,
contributions and margins) have twins too.
"""

from __future__ import annotations

from types import SimpleNamespace

from pyspark.ml.linalg import Vectors
from pyspark.sql import Window
from pyspark.sql import functions as F

from claimscope.functions import expressions as X
from claimscope.functions.values import AGE_LABELS, AGE_MIDPOINTS, CHRONIC_CONDITIONS, FEATURES_D, SEED
from claimscope.operators import explain as E
from claimscope.operators import features as FE
from claimscope.operators import metrics as ME
from claimscope.operators import models as MO
from claimscope.operators import text as TX
from claimscope.operators.claims import claims_full, valid_stay
from claimscope.operators.reports import class_balance
from claimscope.plans.base import query, rounded
from claimscope.plans.sqlgen import age_group_sql, case_map, diag_cols, q, row_id_sql
from claimscope.session import saved
from claimscope.sources import fixture as fx

M1_NUMERIC = (
    ["InscClaimAmtReimbursed", "DeductibleAmtPaid", "Gender", "State", "County"]
    + CHRONIC_CONDITIONS
    + ["IPAnnualReimbursementAmt", "IPAnnualDeductibleAmt", "OPAnnualReimbursementAmt", "OPAnnualDeductibleAmt",
       "LogReimbursed", "LengthOfStay", "Age"]
)
M1_MODEL = M1_NUMERIC + ["AgeMidpoint"]
RID_SQL = row_id_sql(FE.ROW_ID_COLS)

M1_SQL = f"""select {RID_SQL} as RowID, InscClaimAmtReimbursed, DeductibleAmtPaid, Gender, State, County,
  {", ".join(CHRONIC_CONDITIONS)}, IPAnnualReimbursementAmt, IPAnnualDeductibleAmt, OPAnnualReimbursementAmt, OPAnnualDeductibleAmt,
  ln(1 + InscClaimAmtReimbursed) as LogReimbursed, cast(ClaimEndDt - ClaimStartDt as integer) as LengthOfStay,
  cast(2009 - year(DOB) as integer) as Age, {age_group_sql('cast(2009 - year(DOB) as integer)')} as AgeGroup,
  cast(case PotentialFraud when 'Yes' then 1 when 'No' then 0 end as integer) as FraudLabel
from valid_claims
where DeductibleAmtPaid is not null and PotentialFraud in ('Yes', 'No')
  and {age_group_sql('cast(2009 - year(DOB) as integer)')} is not null"""
SPLIT_SQL = f"""select *, rn <= (n * 20 + 99) // 100 as is_test from (
  select *, row_number() over (partition by FraudLabel order by md5(concat_ws('|', '{SEED}', RowID))) as rn,
            count(*) over (partition by FraudLabel) as n
  from m1)"""
EXTRA = [("m1", M1_SQL), ("split", SPLIT_SQL)]


_MEMO: dict = {}


def memo(spark, d, name, fn):
    """Compute once per (session, data folder): fitted models (driver-side
    objects) and checkpointed training sets shared by several queries."""
    key = (id(spark.sparkContext), spark.sparkContext.applicationId, d, name)
    if key not in _MEMO:
        _MEMO[key] = fn()
    return _MEMO[key]


def claims(spark, d):
    """All claims, keyed before patient and label columns are attached."""
    keyed = FE.with_claim_row_id(fx.claims_src(spark, d))
    return claims_full(keyed, fx.beneficiary(spark, d), fx.provider_label(spark, d))


def kept(df):
    """Written once to the shared folder."""
    return saved(df)


def m1(spark, d):
    return FE.features_a(FE.enriched_claims(valid_stay(claims(spark, d))))


def m1_model(spark, d):
    """M1 with the age group as its midpoint (the form the models see)."""
    return m1(spark, d).withColumn("AgeMidpoint", X.age_midpoint("AgeGroup").cast("double")).drop("AgeGroup")


def split(spark, d, *columns):
    """M1 with the flag of the split; only ``columns`` if any are named."""
    df = m1_model(spark, d)
    return FE.stratified_split(df.select(*columns) if columns else df)


# ------------------------------------------------------------ features
@query("m01_features_a", "select * exclude (LogReimbursed), round(LogReimbursed, 9) as LogReimbursed from m1",
       ("M1", "P4", "P7", "P16", "P12", "X1", "X3", "X4", "X5", "W6"), extra_ctes=EXTRA)
def m01_features_a(spark, d):
    return rounded(m1(spark, d), {"LogReimbursed": 9})


@query("a21_class_balance", """
select FraudLabel, round_even(cast(count(*) as double) / sum(count(*)) over (), 4) as share from m1 group by FraudLabel
""", ("A21", "X14"), extra_ctes=EXTRA)
def a21_class_balance(spark, d):
    return class_balance(m1(spark, d), "FraudLabel", 4)


_B_TEXT = ["ClmAdmitDiagnosisCode", "DiagnosisGroupCode", *diag_cols(), "Source", "RenalDiseaseIndicator"]
_B_DATES = ["DOB", "DOD"]


def _m2_sql() -> str:
    from claimscope.sources.readers import BENEFICIARY_SCHEMA  # noqa: F401

    num = (["InscClaimAmtReimbursed", "DeductibleAmtPaid"] + [f"ClmProcedureCode_{i}" for i in range(1, 7)]
           + ["Gender", "Race", "State", "County"] + CHRONIC_CONDITIONS
           + ["IPAnnualReimbursementAmt", "IPAnnualDeductibleAmt", "OPAnnualReimbursementAmt", "OPAnnualDeductibleAmt"])
    cols = [f"coalesce(cast({c} as double), 0.0) as {c}" for c in num]
    cols += [f"coalesce(try_cast({c} as double), 0.0) as {c}" for c in _B_TEXT]
    cols += [f"cast(0.0 as double) as {c}" for c in _B_DATES]
    return f"""select {RID_SQL} as RowID, {", ".join(cols)},
  cast(case PotentialFraud when 'Yes' then 1 when 'No' then 0 end as integer) as FraudLabel from claims_full"""


@query("m02_features_b", _m2_sql(), ("M2", "P11", "P8", "P4", "F3"))
def m02_features_b(spark, d):
    return saved(FE.features_b(claims(spark, d)))


_C_NUM = ["InscClaimAmtReimbursed", "DeductibleAmtPaid", "Gender", "Race", "RenalDiseaseIndicator", "State",
          "IPAnnualReimbursementAmt", "IPAnnualDeductibleAmt", "OPAnnualReimbursementAmt", "OPAnnualDeductibleAmt",
          "Age", "Num_ChronicCond_2", "Source", "TotalClaimAmt", "ReimbursedRatio", "ClaimDuration",
          "num_diagnosis_codes", "num_procedure_codes"]


def _m3_sql() -> str:
    from claimscope.plans.sqlgen import count_equal_sql, count_not_null_sql, proc_cols

    raw = f"""select {RID_SQL} as RowID, InscClaimAmtReimbursed, DeductibleAmtPaid, DiagnosisGroupCode, Gender, Race,
  case when RenalDiseaseIndicator = 'Y' then 1 else 0 end as RenalDiseaseIndicator, State,
  IPAnnualReimbursementAmt, IPAnnualDeductibleAmt, OPAnnualReimbursementAmt, OPAnnualDeductibleAmt,
  cast(floor((date '2009-12-31' - DOB) / 365) as integer) as Age,
  {count_equal_sql(CHRONIC_CONDITIONS, 2)} as Num_ChronicCond_2,
  case Source when 'Inpatient' then 1 when 'Outpatient' then 2 end as Source,
  InscClaimAmtReimbursed + DeductibleAmtPaid as TotalClaimAmt,
  case when InscClaimAmtReimbursed + DeductibleAmtPaid = 0 then 0.0
       else cast(InscClaimAmtReimbursed as double) / (InscClaimAmtReimbursed + DeductibleAmtPaid) end as ReimbursedRatio,
  cast(ClaimEndDt - ClaimStartDt as integer) as ClaimDuration,
  {count_not_null_sql(diag_cols())} as num_diagnosis_codes, {count_not_null_sql(proc_cols())} as num_procedure_codes,
  cast(case PotentialFraud when 'Yes' then 1 when 'No' then 0 end as integer) as FraudLabel
from claims_full"""
    imputed = ", ".join(f"round(coalesce(cast({c} as double), avg({c}) over ()), 9) as {c}" for c in _C_NUM)
    mode = "(select DiagnosisGroupCode from c_raw where DiagnosisGroupCode is not null group by 1 order by count(*) desc, 1 limit 1)"
    return f"""with c_raw as ({raw})
select RowID, {imputed}, coalesce(DiagnosisGroupCode, {mode}) as DiagnosisGroupCode, FraudLabel from c_raw"""


@query("m03_features_c", _m3_sql(), ("M3", "P17", "P18", "P19", "X4", "X8", "X9", "X10", "X3", "P12", "F2"))
def m03_features_c(spark, d):
    df = FE.features_c(claims(spark, d))
    return rounded(df, {c: 9 for c in _C_NUM if c in df.columns})


def topics(spark, d, keyed=None):
    """SVD topic vectors per claim (M16 -> M17) for the modelling claims, which may be given ``keyed``."""
    enr = valid_stay(FE.with_claim_row_id(fx.claims_src(spark, d)) if keyed is None else keyed)
    docs = enr.select("RowID", X.code_document(FE.diag_cols(enr)).alias("DiagDoc"))
    if keyed is None:
        docs = kept(docs)  # read by four passes
    return TX.svd_topics(TX.tfidf(docs, "RowID", "DiagDoc", grouped=True), "RowID", 10)


@query("m04_features_d", None, ("M4", "P14", "P7", "J9"))
def m04_features_d(spark, d):
    # keyed once: the features and the passes over the documents read the written claims
    keyed = FE.with_claim_row_id(fx.claims_src(spark, d))
    keyed = kept(keyed.drop("ClaimID", "AttendingPhysician", "OperatingPhysician", "OtherPhysician", "AdmissionDt", "DischargeDt", *FE.proc_cols(keyed)))
    enr = FE.enriched_claims(valid_stay(claims_full(keyed, fx.beneficiary(spark, d), fx.provider_label(spark, d))))
    return FE.features_d(enr, topics(spark, d, keyed))


_D_COLS = [c for c in FEATURES_D if c not in ("LengthOfStay", "Age", "DiagnosisGroupCode")]
_D_SQL = f"""with base as (select {RID_SQL} as RowID, {", ".join(_D_COLS)}, DiagnosisGroupCode,
  cast(ClaimEndDt - ClaimStartDt as integer) as LengthOfStay, cast(2009 - year(DOB) as integer) as Age,
  cast(case PotentialFraud when 'Yes' then 1 when 'No' then 0 end as integer) as FraudLabel from valid_claims),
full_rows as (select * from base where {" and ".join(f"{c} is not null" for c in FEATURES_D)} and FraudLabel is not null)
select * exclude (DiagnosisGroupCode), cast(dense_rank() over (order by DiagnosisGroupCode) - 1 as integer) as DiagnosisGroupCode
from full_rows"""


@query("m04_features_d_base", _D_SQL, ("M4", "P14", "P7"))
def m04_features_d_base(spark, d):
    """Variant D without topic columns."""
    return FE.features_d(FE.enriched_claims(valid_stay(claims(spark, d))))


# ------------------------------------------------------------ split / encode
@query("m05_split", "select RowID, FraudLabel, is_test from split", "M5", extra_ctes=EXTRA)
def m05_split(spark, d):
    return split(spark, d, "RowID", "FraudLabel").select("RowID", "FraudLabel", "is_test")


@query("m05_split_balance", """
select is_test, FraudLabel, count(*) as count,
  round_even(cast(count(*) as double) / sum(count(*)) over (partition by is_test), 4) as share
from split group by is_test, FraudLabel
""", ("M5", "A21"), extra_ctes=EXTRA)
def m05_split_balance(spark, d):
    counts = split(spark, d, "RowID", "FraudLabel").groupBy("is_test", "FraudLabel").agg(F.count(F.lit(1)).alias("count"))
    part = F.sum("count").over(Window.partitionBy("is_test"))  # four rows
    return counts.withColumn("share", F.bround(F.col("count") / part, 4))


@query("m06_one_hot", "select RowID, is_test, " + ", ".join(
    f"case when AgeGroup = {q(lv)} then 1 else 0 end as \"AgeGroup_{lv}\"" for lv in AGE_LABELS[1:]
) + " from split", ("M6",), extra_ctes=EXTRA)
def m06_one_hot(spark, d):
    s = FE.stratified_split(m1(spark, d).select("RowID", "FraudLabel", "AgeGroup"))
    tr, va = FE.one_hot(s.where(~F.col("is_test")), s.where(F.col("is_test")), "AgeGroup", AGE_LABELS)
    cols = ["RowID", "is_test"] + [f"AgeGroup_{lv}" for lv in AGE_LABELS[1:]]
    return tr.select(*cols).unionByName(va.select(*cols))


# ------------------------------------------------------------ models
def _train_val(spark, d):
    s = memo(spark, d, "split", lambda: split(spark, d))
    return s.where(~F.col("is_test")), s.where(F.col("is_test"))


def _default_gbt(spark, d):
    """Boosted trees with the library defaults on M1 (shared by M14/M15)."""
    tr, _ = _train_val(spark, d)
    return memo(spark, d, "gbt_default", lambda: MO.fit_gbt(tr, M1_MODEL))


@query("m07_logistic_predictions", None, ("M7",))
def m07_logistic_predictions(spark, d):
    tr, va = _train_val(spark, d)
    return MO.predict(_logistic(spark, d), va, M1_MODEL)


def _logistic(spark, d):
    tr, _ = _train_val(spark, d)
    return memo(spark, d, "logistic", lambda: MO.fit_logistic(tr, M1_MODEL))


@query("m07_logistic_report", None, ("M7", "M11", "M12"))
def m07_logistic_report(spark, d):
    tr, va = _train_val(spark, d)
    return _report(_logistic(spark, d), va, M1_MODEL)


@query("m11_confusion_logistic", None, ("M7", "M11"))
def m11_confusion_logistic(spark, d):
    return ME.confusion(m07_logistic_predictions(spark, d))


@query("m12_roc_curve_logistic", None, ("M7", "M12"))
def m12_roc_curve_logistic(spark, d):
    return ME.roc_curve(m07_logistic_predictions(spark, d))


@query("m07_logistic_b_report", None, ("M7", "M2", "M11", "M12"))
def m07_logistic_b_report(spark, d):
    """Logistic regression on the zero-filled variant B."""
    df, feats = _features_b_model(spark, d)
    s = FE.stratified_split(df)
    return _report(MO.fit_logistic(s.where(~F.col("is_test")), feats), s.where(F.col("is_test")), feats)


@query("m08_gbt_report", None, ("M8", "M11", "M12"))
def m08_gbt_report(spark, d):
    tr, va = _train_val(spark, d)
    model = MO.fit_gbt(tr, M1_MODEL, rounds=200, depth=6, rate=0.1, subsample=0.8, col_sample=0.8)
    return _report(model, va, M1_MODEL)


@query("m08_gbt_topics_report", None, ("M8", "M4", "M16", "M17", "M11", "M12"))
def m08_gbt_topics_report(spark, d):
    df = FE.stratified_split(m04_features_d(spark, d))
    feats = [c for c in df.columns if c not in ("RowID", "FraudLabel", "is_test")]
    tr, va = df.where(~F.col("is_test")), df.where(F.col("is_test"))
    return _report(MO.fit_gbt(tr, feats), va, feats)


def _features_b_model(spark, d):
    df = FE.features_b(claims(spark, d)).where(F.col("FraudLabel").isNotNull())
    feats = [c for c in df.columns if c not in ("RowID", "FraudLabel")]
    return df, feats


def _features_c_model(spark, d):
    df = FE.features_c(claims(spark, d)).where(F.col("FraudLabel").isNotNull())
    df = df.withColumn("DiagnosisGroupCode", F.col("DiagnosisGroupCode").try_cast("double"))
    feats = [c for c in df.columns if c not in ("RowID", "FraudLabel")]
    return df, feats


def _smote_parts(spark, d):
    """Variant C split 80/20; the training part balanced with SMOTE."""
    from claimscope.operators.smote import smote

    def build():
        df, feats = _features_c_model(spark, d)
        s = FE.stratified_split(df)
        train = kept(smote(s.where(~F.col("is_test")), feats))
        return train, s.where(F.col("is_test")), feats

    return memo(spark, d, "smote_parts", build)


def _report(model, val, feats):
    pred = MO.predict(model, val, feats)
    auc = ME.roc_auc(pred).select("auc").scalar()
    return ME.classification_report(pred).withColumn("auc", auc)


@query("m18_smote", None, ("M18", "M3", "M5"))
def m18_smote(spark, d):
    train, _, _ = _smote_parts(spark, d)
    return train


@query("m18_smote_gbt_report", None, ("M18", "M8", "M11", "M12"))
def m18_smote_gbt_report(spark, d):
    """Boosted trees (100 rounds, depth 5, rate 0.1) on the SMOTE-balanced
    training part, scored on the untouched validation part."""
    train, val, feats = _smote_parts(spark, d)
    return _report(_smote_gbt(spark, d), val, feats)


def _smote_gbt(spark, d):
    train, _, feats = _smote_parts(spark, d)
    return memo(spark, d, "smote_gbt", lambda: MO.fit_gbt(train, feats, rounds=100, depth=5, rate=0.1))


def _forest(spark, d):
    train, _, feats = _smote_parts(spark, d)
    return memo(spark, d, "forest", lambda: MO.fit_rf(train, feats, trees=100, depth=10))


@query("m09_rf_report", None, ("M9", "M18", "M11", "M12"))
def m09_rf_report(spark, d):
    """Random forest, 100 trees of depth 10, on the SMOTE-balanced part."""
    _, val, feats = _smote_parts(spark, d)
    return _report(_forest(spark, d), val, feats)


@query("m11_confusion_forest", None, ("M9", "M18", "M11"))
def m11_confusion_forest(spark, d):
    _, val, feats = _smote_parts(spark, d)
    return ME.confusion(MO.predict(_forest(spark, d), val, feats))


@query("m12_roc_curve_forest", None, ("M9", "M18", "M12"))
def m12_roc_curve_forest(spark, d):
    _, val, feats = _smote_parts(spark, d)
    return ME.roc_curve(MO.predict(_forest(spark, d), val, feats))


@query("m10_forest_importance", None, ("M10", "M9", "M18"))
def m10_forest_importance(spark, d):
    """Top-20 importances of the forest trained after SMOTE."""
    _, _, feats = _smote_parts(spark, d)
    return MO.feature_importance(spark, _forest(spark, d), feats, 20)


@query("m07_smote_logistic_report", None, ("M7", "M18", "M11", "M12"))
def m07_smote_logistic_report(spark, d):
    train, val, feats = _smote_parts(spark, d)
    return _report(MO.fit_logistic(train, feats), val, feats)


@query("m10_feature_importance", None, ("M10", "M8", "M18"))
def m10_feature_importance(spark, d):
    """Top-20 importances of the boosted trees trained after SMOTE."""
    _, _, feats = _smote_parts(spark, d)
    return MO.feature_importance(spark, _smote_gbt(spark, d), feats, 20)


@query("m10_importance_total", f"""
select 1.0::double as total, cast({len(M1_MODEL)} as bigint) as n_features, cast(0 as bigint) as n_negative
""", ("M10", "M8"))
def m10_importance_total(spark, d):
    """What importances of a fitted model must satisfy: one a feature, none negative, sum 1."""
    imp = MO.feature_importance(spark, _default_gbt(spark, d), M1_MODEL, None)
    return imp.agg(F.round(F.sum("Importance"), 9).alias("total"), F.count(F.lit(1)).alias("n_features"),
                   F.count_if(F.col("Importance") < 0).alias("n_negative"))


@query("m13_fold_sizes", """
select cast((rn - 1) % 5 as integer) as fold, FraudLabel, count(*) as count from split group by all
""", "M13", extra_ctes=EXTRA)
def m13_fold_sizes(spark, d):
    return FE.stratified_folds(m1(spark, d).select("RowID", "FraudLabel")).groupBy("fold", "FraudLabel").agg(F.count(F.lit(1)).alias("count"))


@query("m13_cross_validation", None, ("M13", "M8", "M11", "M12"))
def m13_cross_validation(spark, d):
    df = kept(FE.stratified_folds(m1_model(spark, d)))
    return MO.cross_validate(df, M1_MODEL, lambda tr, f, lbl: MO.fit_gbt(tr, f, lbl))


# ------------------------------------------------------------ metrics on a fixed rule score
RULE_SQL = """select FraudLabel as label,
  case when InscClaimAmtReimbursed + DeductibleAmtPaid = 0 then 0.0
       else cast(InscClaimAmtReimbursed as double) / (InscClaimAmtReimbursed + DeductibleAmtPaid) end as score
from m1"""
RULE_PRED_SQL = f"select label, score, cast(score > 0.99 as integer) as prediction from ({RULE_SQL})"


def rule_predictions(spark, d):
    """A fixed, model-free score (X10 ratio) and 0/1 prediction used to
    check the metric operators exactly."""
    src = fx.claims_src(spark, d).withColumn("RowID", F.lit(None).cast("string"))  # no row is looked up by its id
    full_claims = claims_full(src, fx.beneficiary(spark, d), fx.provider_label(spark, d))
    df = FE.features_a(FE.enriched_claims(valid_stay(full_claims)))
    score = X.reimbursed_ratio()
    return df.select(F.col("FraudLabel").alias("label"), score.alias("score"),
                     (score > 0.99).cast("int").alias("prediction"))


@query("m11_confusion", f"""
select l.label, p.prediction, cast(count(r.label) as bigint) as count
from (values (0), (1)) l(label) cross join (values (0), (1)) p(prediction)
left join ({RULE_PRED_SQL}) r on r.label = l.label and r.prediction = p.prediction
group by l.label, p.prediction
""", "M11", extra_ctes=EXTRA)
def m11_confusion(spark, d):
    return ME.confusion(rule_predictions(spark, d))


def _report_sql() -> str:
    return f"""with c as (
  select count_if(label = 0 and prediction = 0) as c00, count_if(label = 0 and prediction = 1) as c01,
         count_if(label = 1 and prediction = 0) as c10, count_if(label = 1 and prediction = 1) as c11
  from ({RULE_PRED_SQL})),
r as (select *,
  case when c00 + c10 = 0 then 0.0 else cast(c00 as double) / (c00 + c10) end as p0,
  case when c00 + c01 = 0 then 0.0 else cast(c00 as double) / (c00 + c01) end as r0,
  case when c11 + c01 = 0 then 0.0 else cast(c11 as double) / (c11 + c01) end as p1,
  case when c11 + c10 = 0 then 0.0 else cast(c11 as double) / (c11 + c10) end as r1,
  c00 + c01 as s0, c10 + c11 as s1, c00 + c01 + c10 + c11 as n from c),
f as (select *, case when p0 + r0 = 0 then 0.0 else 2 * p0 * r0 / (p0 + r0) end as f0,
                case when p1 + r1 = 0 then 0.0 else 2 * p1 * r1 / (p1 + r1) end as f1 from r)
select '0' as "row", round(p0, 12) as precision, round(r0, 12) as recall, round(f0, 12) as f1, cast(s0 as bigint) as support from f
union all select '1', round(p1, 12), round(r1, 12), round(f1, 12), cast(s1 as bigint) from f
union all select 'accuracy', null, null, round(case when n = 0 then 0.0 else cast(c00 + c11 as double) / n end, 12), cast(n as bigint) from f
union all select 'macro avg', round((p0 + p1) / 2, 12), round((r0 + r1) / 2, 12), round((f0 + f1) / 2, 12), cast(n as bigint) from f
union all select 'weighted avg', round(case when n = 0 then 0.0 else (p0 * s0 + p1 * s1) / n end, 12),
  round(case when n = 0 then 0.0 else (r0 * s0 + r1 * s1) / n end, 12),
  round(case when n = 0 then 0.0 else (f0 * s0 + f1 * s1) / n end, 12), cast(n as bigint) from f"""


@query("m11_classification_report", _report_sql(), "M11", extra_ctes=EXTRA)
def m11_classification_report(spark, d):
    return rounded(ME.classification_report(rule_predictions(spark, d)), {"precision": 12, "recall": 12, "f1": 12})


@query("m12_roc_auc", f"""
with s as (select score, count_if(label = 1) as pos, count_if(label = 0) as neg from ({RULE_SQL}) group by score),
c as (select *, sum(pos) over (order by score desc rows between unbounded preceding and 1 preceding) as higher from s)
select cast(sum(neg * (2 * coalesce(higher, 0) + pos)) as double) / (2 * sum(pos) * sum(neg)) as auc from c
""", "M12", extra_ctes=EXTRA)
def m12_roc_auc(spark, d):
    return ME.roc_auc(rule_predictions(spark, d))


@query("m12_roc_curve", f"""
with s as (select score, count_if(label = 1) as pos, count_if(label = 0) as neg from ({RULE_SQL}) group by score),
c as (select score, sum(pos) over (order by score desc) as cp, sum(neg) over (order by score desc) as cn from s)
select 0.0 as fpr, 0.0 as tpr, 'inf'::double as threshold
union all
select round(cast(cn as double) / (select sum(neg) from s), 12), round(cast(cp as double) / (select sum(pos) from s), 12), score from c
""", "M12", extra_ctes=EXTRA)
def m12_roc_curve(spark, d):
    return rounded(ME.roc_curve(rule_predictions(spark, d)), {"fpr": 12, "tpr": 12})


# ------------------------------------------------------------ contributions / explanation
def _fixed_contrib_sql() -> str:
    ent = ", ".join(
        f"({q(c)}, cast({c} as double) - (select avg(cast({c} as double)) from m1))" for c in M1_NUMERIC
    )
    return f"""with v as (select m1.*, is_test from m1 join (select RowID as r2, is_test from split) s on m1.RowID = s.r2 where is_test),
lng as (select RowID, FraudLabel, t.feature, t.value from v, lateral (select * from (values {ent}) x(feature, value)) t),
top as (select *, row_number() over (partition by RowID order by abs(value) desc, feature) as r from lng),
txt as (select RowID, FraudLabel, string_agg(printf('- %s: %.4f', feature, value) || chr(10), '' order by r) as body
        from top where r <= 10 group by RowID, FraudLabel)
select RowID, FraudLabel, chr(10) || {q(E.EXPLAIN_ROLE)} || ' ' ||
  case when FraudLabel = 1 then {q(E.EXPLAIN_OPEN_FRAUD)} else {q(E.EXPLAIN_OPEN_OK)} end ||
  chr(10) || chr(10) || {q(E.EXPLAIN_HEADER)} || chr(10) || body || chr(10) ||
  case when FraudLabel = 1 then {q(E.EXPLAIN_CLOSE_FRAUD)} else {q(E.EXPLAIN_CLOSE_OK)} end as prompt
from txt"""


@query("m15_explanation_fixed", _fixed_contrib_sql(), ("M15", "O4", "W2", "X14"), extra_ctes=EXTRA)
def m15_explanation_fixed(spark, d):
    df = FE.stratified_split(m1(spark, d))
    means = df.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in M1_NUMERIC]).first()  # one statistics row
    vals = {c: F.col(c).cast("double") - F.lit(float(means[c])) for c in M1_NUMERIC}
    v = df.where(F.col("is_test"))
    contrib = E._long(v, "RowID", vals, keep=["FraudLabel"])
    return E.explanation_prompt(contrib)


@query("m14_tree_contributions", None, ("M14", "F4"))
def m14_tree_contributions(spark, d):
    _, va = _train_val(spark, d)
    contrib, base = E.tree_contributions(_default_gbt(spark, d), va, M1_MODEL)
    return contrib.withColumn("base", F.lit(base))


@query("m14_mean_abs_contribution", None, ("M14",))
def m14_mean_abs_contribution(spark, d):
    _, va = _train_val(spark, d)
    contrib, _ = E.tree_contributions(_default_gbt(spark, d), va, M1_MODEL)
    return E.mean_abs_contribution(contrib, 10)


@query("m14_linear_contributions", None, ("M14", "M7"))
def m14_linear_contributions(spark, d):
    tr, va = _train_val(spark, d)
    contrib, base = E.linear_contributions(_logistic(spark, d), tr, va, M1_MODEL)
    return contrib.withColumn("base", F.lit(base))


#: Fixed coefficients, so that the linear contributions have an exact twin.
_COEFS = [(-1) ** i * (i + 1) / 8 for i in range(len(M1_NUMERIC))]


def _fixed_linear_sql() -> str:
    mean = "(select avg(cast({0} as double)) from split where not is_test)"
    ent = ", ".join(f"({q(c)}, {w}::double * (cast({c} as double) - {mean.format(c)}))" for c, w in zip(M1_NUMERIC, _COEFS, strict=True))
    base = " + ".join(f"{w}::double * {mean.format(c)}" for c, w in zip(M1_NUMERIC, _COEFS, strict=True))
    return f"""select RowID, t.feature, round(t.value, 6) as value, round((select 0.25::double + ({base})), 6) as base
from split, lateral (select * from (values {ent}) x(feature, value)) t where is_test"""


@query("m14_linear_fixed", _fixed_linear_sql(), "M14", extra_ctes=EXTRA)
def m14_linear_fixed(spark, d):
    """Linear contributions for fixed coefficients: coefficient times distance from the training mean."""
    tr, va = _train_val(spark, d)
    model = SimpleNamespace(coefficients=Vectors.dense(_COEFS), intercept=0.25)
    contrib, base = E.linear_contributions(model, tr, va, M1_NUMERIC)
    return rounded(contrib.withColumn("base", F.lit(base)), {"value": 6, "base": 6})


@query("m14_additivity", """
select count(*) as n_rows, count(*) as n_additive from split where is_test
""", ("M14", "M8"), extra_ctes=EXTRA)
def m14_additivity(spark, d):
    """What contributions must satisfy: with the base value they sum to the model's margin, row by row."""
    _, va = _train_val(spark, d)
    model = _default_gbt(spark, d)
    contrib, base = E.tree_contributions(model, va, M1_MODEL)
    sums = contrib.groupBy("RowID").agg(F.sum("value").alias("total"))
    both = E.raw_margin(model, va, M1_MODEL).join(sums, "RowID", "left")
    same = F.abs(F.col("total") + F.lit(base) - F.col("margin")) < 1e-6
    return both.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(same).alias("n_additive"))


@query("m15_claim_breakdown", None, ("M14", "O1"))
def m15_claim_breakdown(spark, d):
    """Every feature's contribution for one claim, the first of the validation part by RowID, largest first."""
    _, va = _train_val(spark, d)
    one = va.orderBy("RowID").limit(1)
    contrib, base = E.tree_contributions(_default_gbt(spark, d), one, M1_MODEL)
    return contrib.withColumn("base", F.lit(base)).orderBy(F.desc(F.abs("value")), "feature")


@query("m11_confusion_gbt", None, ("M8", "M11"))
def m11_confusion_gbt(spark, d):
    _, va = _train_val(spark, d)
    return ME.confusion(MO.predict(_default_gbt(spark, d), va, M1_MODEL))


@query("m12_roc_curve_gbt", None, ("M8", "M12"))
def m12_roc_curve_gbt(spark, d):
    _, va = _train_val(spark, d)
    return ME.roc_curve(MO.predict(_default_gbt(spark, d), va, M1_MODEL))


@query("m15_explanation_model", None, ("M15", "M14"))
def m15_explanation_model(spark, d):
    _, va = _train_val(spark, d)
    contrib, _ = E.tree_contributions(_default_gbt(spark, d), va, M1_MODEL, keep=["FraudLabel"])
    return E.explanation_prompt(contrib)


# ------------------------------------------------------------ text
def _tfidf_sql(document: str) -> str:
    return f"""
with docs as (select {RID_SQL} as RowID, lower({document}) as t from valid_claims),
n as (select count(*) as n from docs),
terms as (select RowID, unnest(regexp_extract_all(t, '\\b\\w\\w+\\b')) as term from docs),
tf as (select RowID, term, count(*) as tf from terms group by RowID, term),
idf as (select term, ln((1 + (select n from n)) / (1 + count(*))) + 1 as idf from tf group by term),
w as (select tf.RowID, tf.term, tf.tf, idf.idf, tf.tf * idf.idf as raw from tf join idf on tf.term = idf.term)
select RowID, term, tf, round(idf, 9) as idf, round(raw / sqrt(sum(raw * raw) over (partition by RowID)), 9) as weight from w
"""


def _tfidf(spark, d, compat: bool):
    enr = valid_stay(FE.with_claim_row_id(fx.claims_src(spark, d)))
    docs = enr.select("RowID", X.code_document(FE.diag_cols(enr), compat).alias("DiagDoc"))
    return rounded(TX.tfidf(docs, "RowID", "DiagDoc"), {"idf": 9, "weight": 9})


@query("m16_tfidf", _tfidf_sql(f"concat_ws(' ', {', '.join(diag_cols())})"), ("M16", "X13"))
def m16_tfidf(spark, d):
    return _tfidf(spark, d, compat=False)


@query("m16_tfidf_nan_tokens", _tfidf_sql("concat_ws(' ', " + ", ".join(f"coalesce({c}, 'nan')" for c in diag_cols()) + ")"), ("M16", "X13"))
def m16_tfidf_nan_tokens(spark, d):
    """The literal form of the document: a missing code is the token ``nan``."""
    return _tfidf(spark, d, compat=True)


@query("m17_svd_topics", None, ("M17", "M16", "J9"))
def m17_svd_topics(spark, d):
    return topics(spark, d)
