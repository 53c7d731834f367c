"""What the plans read, and behaviour on data that the fixture does not contain."""

import pytest
from pyspark.sql import functions as F

from claimscope.operators.features import stratified_split
from claimscope.operators.metrics import roc_auc, roc_curve
from claimscope.operators.models import MAX_DEPTH, fit_gbt, fit_logistic, fit_rf, predict
from claimscope.operators.smote import smote
from claimscope.operators.windows import with_row_id
from claimscope.plans.registry import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["a02_claims_per_provider", "a18_duplicate_claim_ids", "a22_top_codes", "g01_bipartite_vertices", "g04_tripartite_edges", "g07_degrees", "w01_overlap_count", "u05_melt_diagnosis", "x01_log_reimbursed"])
def test_no_unused_sides(spark, name):
    plan = queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "c_custkey" not in plan and "s_suppkey" not in plan


@pytest.mark.parametrize("name", ["a01_label_distribution", "a23_top_codes_by_label", "g02_bipartite_edges"])
def test_no_unused_patients(spark, name):
    plan = queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "c_custkey" not in plan and "s_suppkey" in plan


def test_session_settings_stay(spark):
    before = dict(spark.conf.getAll)
    queries()["m01_features_a"](spark, SF)
    assert dict(spark.conf.getAll) == before


def test_row_ids_of_copies_are_unique(spark):
    df = spark.createDataFrame([(1, "a", None), (1, "a", None), (1, None, "a"), (2, "a", "x"), (1, "a", None)], "k int, a string, b string")
    got = with_row_id(df)
    assert got.count() == 5 and got.select("RowID").distinct().count() == 5
    ids = lambda d: sorted(r.RowID for r in with_row_id(d).collect())
    assert ids(df) == ids(df.repartition(3))


def test_auc_of_counts_beyond_64_bits(spark):
    """Score counts of 9e9 a class: their product exceeds a 64-bit integer."""
    from claimscope.operators import metrics

    counts = spark.createDataFrame([(0.2, 0, 9 * 10**9), (0.8, 9 * 10**9, 0), (0.5, 10, 10)], "score double, pos bigint, neg bigint")
    original, metrics._score_counts = metrics._score_counts, lambda *a: counts
    try:
        assert abs(roc_auc(counts).first()["auc"] - 1.0) < 1e-8
    finally:
        metrics._score_counts = original


def test_curve_of_crowded_scores(spark):
    """90 % of the distinct scores lie in a tiny interval."""
    n = 3000
    df = spark.range(n).select((F.when(F.col("id") < 0.9 * n, F.col("id") * 1e-12).otherwise(F.col("id") / n)).alias("score"), (F.hash("id") % 2 == 0).cast("int").alias("label"))
    rows = sorted(((r.score, r.label) for r in df.collect()), reverse=True)
    pos, neg = sum(y for _, y in rows), sum(1 - y for _, y in rows)
    want, p, q = [(0.0, 0.0)], 0, 0
    for _, y in rows:
        p, q = p + y, q + 1 - y
        want.append((q / neg, p / pos))
    got = sorted((r.fpr, r.tpr) for r in roc_curve(df).collect())
    assert len(got) == len(want)
    assert all(a == pytest.approx(b) for a, b in zip(got, sorted(want), strict=True))


@pytest.fixture(scope="module")
def signal(spark):
    """Two features, of which the first decides the label."""
    x = F.rand(1)
    df = spark.range(600).select(F.col("id").cast("string").alias("RowID"), x.alias("f1"), F.rand(2).alias("f2"))
    return df.withColumn("FraudLabel", (F.col("f1") > 0.6).cast("int")).cache()


@pytest.mark.parametrize("fit", [fit_logistic, lambda d, f: fit_gbt(d, f, rounds=5, depth=3), lambda d, f: fit_rf(d, f, trees=10, depth=4)])
def test_models_find_a_planted_signal(signal, fit):
    s = stratified_split(signal)
    model = fit(s.where("not is_test"), ["f1", "f2"])
    assert roc_auc(predict(model, s.where("is_test"), ["f1", "f2"])).first()["auc"] > 0.95


def test_depth_beyond_the_limit_is_an_error(signal):
    with pytest.raises(ValueError, match="depth"):
        fit_rf(signal, ["f1"], depth=MAX_DEPTH + 1)


def test_smote_balances_repeated_rows(spark):
    rows = [("a", 1.0, 2.0, 1)] * 5 + [("b", 2.0 + i, 1.0, 1) for i in range(5)] + [("c", float(i), 0.0, 0) for i in range(40)]
    df = with_row_id(spark.createDataFrame(rows, "n string, f1 double, f2 double, FraudLabel int"))
    out = smote(df, ["f1", "f2"])
    assert {r.FraudLabel: r["count"] for r in out.groupBy("FraudLabel").count().collect()} == {0: 40, 1: 40}
