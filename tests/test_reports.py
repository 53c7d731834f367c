"""Edge-case frames for the report, window and cleanup operators."""

import datetime as dt
import math

from pyspark.sql import functions as F

from claimscope.functions import expressions as X
from claimscope.operators import cleanup, reports as R, stats as S, windows as W
from claimscope.operators.claims import union_claims

D = dt.date


def rows(df, *cols):
    src = df.select(*cols) if cols else df
    return sorted((tuple(r) for r in src.collect()), key=str)


def test_label_distribution_drops_null_labels(spark):
    df = spark.createDataFrame([("Yes",), ("No",), ("No",), (None,)], "PotentialFraud string")
    out = {r.PotentialFraud: (r["count"], r.proportion, r.percent) for r in R.label_distribution(df).collect()}
    assert out == {"No": (2, 2 / 3, 66.67), "Yes": (1, 1 / 3, 33.33)}


def test_condition_stats_denominators(spark):
    # the total includes the unlabelled claim, the percents do not
    df = spark.createDataFrame([(1, "Yes"), (1, "No"), (1, None), (2, "Yes")], "ChronicCond_stroke int, PotentialFraud string")
    r = R.condition_fraud_stats(df, ["ChronicCond_stroke"]).first()
    assert (r.Condition, r.TotalWithCondition, r.FraudCount, r.NoFraudCount, r.PctFraud) == ("stroke", 3, 1, 1, 50.0)


def test_high_provider_summary_null_label_is_not_yes(spark):
    data = [("B1", f"C{i}", f"P{i}", "Yes" if i < 2 else None) for i in range(4)]
    df = spark.createDataFrame(data, "BeneID string, ClaimID string, Provider string, PotentialFraud string")
    from claimscope.functions.values import CHRONIC_CONDITIONS

    df = df.withColumns({c: F.lit(1 if i < 3 else 2) for i, c in enumerate(CHRONIC_CONDITIONS)})
    r = R.high_provider_summary(df, min_providers=4, k=None).first()
    assert (r.NumClaims, r.NumProviders, r.AvgChronicConditions, r.PercentFraud) == (4, 4, 3.0, 50.0)
    assert R.high_provider_summary(df, min_providers=5, k=None).count() == 0


def test_age_bins_left_closed_and_empty_bins_kept(spark):
    ages = [0, 19, 20, 79, 80, 99, 100, None]
    df = spark.createDataFrame([(a, "Yes") for a in ages], "Age int, PotentialFraud string")
    out = {r.AgeGroup: r.Total for r in R.fraud_rate_by_age_group(df, F.col("Age")).collect()}
    assert out["0–20"] == 2 and out["21–30"] == 1 and out["71–80"] == 1 and out["81+"] == 2
    assert out["31–40"] == 0  # empty category kept
    assert sum(out.values()) == 6  # 100 and null are outside every bin
    pct = {r.AgeGroup: r.PctFraud for r in R.fraud_rate_by_age_group(df, F.col("Age")).collect()}
    assert pct["31–40"] is None and pct["0–20"] == 100.0


def test_duplicates_null_equals_null(spark):
    df = spark.createDataFrame([("P", "1", None), ("P", "1", None), ("P", "2", None)],
                               "Provider string, ClmDiagnosisCode_1 string, ClmProcedureCode_1 int")
    keys = ["Provider", "ClmDiagnosisCode_1", "ClmProcedureCode_1"]
    assert R.duplicate_count(df, keys).first().n_duplicates == 1
    flags = W.flag_duplicates(df, keys, keep=False, name="f")
    assert sorted(r.f for r in flags.collect()) == [False, True, True]


def test_both_duplicate_flags_shuffle_the_rows_once(spark):
    rows = [(k, v, i) for i, (k, v) in enumerate([("a", 1), ("a", 1), ("a", None), (None, 1), (None, 1), ("b", 2), ("a", 1), (None, None)])]
    rows += [("hot", i % 2, 100 + i) for i in range(60)]
    df = spark.createDataFrame(rows, "k string, v int, i int")
    found = [sorted(tuple(r) for r in W.hot_keys(df, ["k", "v"], n).collect()) for n in (20, 1000)]
    assert found == [[("hot", 0), ("hot", 1)], []]
    for hot_rows in (20, 1000, 0):
        flagged = W.flag_duplicates(df, ["k", "v"], keep=False, name="every", hot_rows=hot_rows)
        flagged = W.flag_duplicates(flagged, ["k", "v"], keep="first", order=["i"], name="later", hot_rows=hot_rows)
        if hot_rows == 1000:
            plan = flagged._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
        seen, want = {}, {}
        for k, v, i in rows:
            seen.setdefault((k, v), []).append(i)
        for members in seen.values():
            want |= {i: (len(members) > 1, i > min(members)) for i in members}
        assert {r.i: (r.every, r.later) for r in flagged.collect()} == want


def test_duplicate_label_split_denominator_includes_unlabelled(spark):
    df = spark.createDataFrame([("a", "Yes"), ("a", None), ("b", "No"), ("c", "No"), ("c", "No")], "k string, PotentialFraud string")
    out = {r.PotentialFraud: (r["count"], r.percent) for r in R.duplicate_label_split(df, ["k"]).collect()}
    assert out == {"Yes": (1, 25.0), "No": (2, 50.0)}


def test_overlap_only_immediate_predecessor(spark):
    data = [("B", D(2009, 1, 1), D(2009, 1, 31), "c1"), ("B", D(2009, 1, 5), D(2009, 1, 6), "c2"),
            ("B", D(2009, 1, 20), D(2009, 1, 21), "c3")]
    df = spark.createDataFrame(data, "BeneID string, ClaimStartDt date, ClaimEndDt date, ClaimID string")
    flags = {r.ClaimID: r.Overlap for r in W.overlap_flags(df).collect()}
    assert flags == {"c1": False, "c2": True, "c3": False}  # c3 lies inside c1 but c2 precedes it
    assert W.overlap_count(df).first().overlap_count == 1


def test_top_k_ties_use_tie_key(spark):
    df = spark.createDataFrame([("P2",), ("P1",), ("P3",), ("P3",)], "Provider string")
    out = [r.Provider for r in R.claims_per_provider(df, 2).collect()]
    assert out == ["P3", "P1"]


def test_union_missing_columns_become_null(spark):
    ip = spark.createDataFrame([("c1", D(2009, 1, 1))], "ClaimID string, AdmissionDt date")
    op = spark.createDataFrame([("c2",)], "ClaimID string")
    out = {r.ClaimID: (r.AdmissionDt, r.Source) for r in union_claims(ip, op).collect()}
    assert out == {"c1": (D(2009, 1, 1), "Inpatient"), "c2": (None, "Outpatient")}


def test_merge_counts_zero_filled(spark):
    ip = spark.createDataFrame([("P1", 2)], "Provider string, InpatientClaimCount long")
    op = spark.createDataFrame([("P2", 3)], "Provider string, OutpatientClaimCount long")
    out = rows(R.merge_counts(ip, op))
    assert out == [("P1", 2, 0), ("P2", 0, 3)]


def test_unmapped_codes(spark):
    df = spark.createDataFrame([(4, 3, "Yes"), (1, 1, "No")], "Race int, State int, PotentialFraud string")
    races = rows(R.fraud_rate_by(df.withColumn("Race", X.map_values("Race", {1: "White"})), "Race"), "Race")
    assert races == [("White",)]  # null race leaves the table
    states = {r.State: r.StateName for r in R.top_states(df, None).collect()}
    assert states == {3: None, 1: "Alabama"}  # null state name stays


def test_ratio_and_lenient_parsing(spark):
    df = spark.createDataFrame([(0, 0, "not a date"), (5, None, "1950-02-03"), (3, 1, None)],
                               "InscClaimAmtReimbursed long, DeductibleAmtPaid long, DOB string")
    out = df.select(X.reimbursed_ratio().alias("r"), X.parse_date("DOB", lenient=True).alias("d")).collect()
    assert [r.r for r in out] == [0.0, None, 0.75]
    assert [r.d for r in out] == [None, D(1950, 2, 3), None]


def test_column_pruning_and_imputation(spark):
    df = spark.createDataFrame(
        [(1, None, "a", 2.0), (1, None, "b", None), (1, 5.0, "b", 4.0), (1, None, "a", None)] + [(1, None, None, 1.0)] * 16,
        "const int, mostly_null double, cat string, x double",
    )
    assert cleanup.single_valued_cols(df) == ["const", "mostly_null"]  # one non-null value counts as single
    assert cleanup.high_missing_cols(df, 0.9) == ["mostly_null"]
    vals = cleanup.impute_values(df, ["cat", "x"])
    assert vals["cat"] == "a"  # tie between a and b -> smallest
    assert abs(vals["x"] - (2.0 + 4.0 + 16.0) / 18) < 1e-12


def test_category_codes(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("b",)], "g string")
    out = rows(cleanup.category_codes(df, "g", "code"))
    assert out == sorted([("a", 0), ("b", 1), ("b", 1), (None, -1)], key=str)


def test_tokens_lowercase_and_min_length(spark):
    from claimscope.operators.text import tfidf

    df = spark.createDataFrame([("r1", "A b1 B1 nan"), ("r2", "b1")], "k string, t string")
    out = {(r.k, r.term): r.tf for r in tfidf(df, "k", "t").collect()}
    assert out == {("r1", "b1"): 2, ("r1", "nan"): 1, ("r2", "b1"): 1}


def test_overlap_count_grouped_equals_window(spark):
    import random

    rnd = random.Random(5)
    data = []
    for i in range(400):
        b = f"B{rnd.randint(0, 6)}"
        s = D(2009, 1, 1) + dt.timedelta(days=rnd.randint(0, 40))
        e = s + dt.timedelta(days=rnd.randint(-2, 6))
        data.append((b, s, e, f"C{rnd.randint(0, 150)}"))
    df = spark.createDataFrame(data, "BeneID string, ClaimStartDt date, ClaimEndDt date, ClaimID string")
    assert W.overlap_count(df).first()[0] == W.overlap_count_window(df).first()[0]


def test_previous_rows_of_a_hot_key_are_cut_into_parts(spark):
    # a third of the rows is one key; half of these are equal in all columns
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.concat(F.lit("k"), F.col("id") % 50)).alias("k"),
        F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id") % 40).alias("o"))
    df = df.withColumn("end", F.when(F.col("o") % 5 > 0, F.col("o")))
    parts = W.ordered_parts(df.where("k = 'hot'"), ["k"], ["o"], 100)
    sizes = [r["count"] for r in parts.groupBy("_b").count().collect()]
    assert sum(sizes) == 1000 and max(sizes) <= 300
    out = W.with_previous(df, ["k"], ["o"], F.col("end"), "prev", hot_rows=100)
    plain = W.with_previous(df, ["k"], ["o"], F.col("end"), "prev")
    assert out.columns == plain.columns and out.count() == 3000
    assert out.exceptAll(plain).count() == 0 and plain.exceptAll(out).count() == 0
    later = W.flag_duplicates(df, ["k"], keep="first", name="later", hot_rows=100)
    firsts = later.where("not later").groupBy("k").count().collect()
    assert len(firsts) == df.select("k").distinct().count() and all(r["count"] == 1 for r in firsts)
    # without an order the rows of a key are equal, and its parts stay small
    sizes = [r["count"] for r in W.ordered_parts(df.where("k = 'hot'").select("k"), ["k"], [], 100).groupBy("_b").count().collect()]
    assert max(sizes) <= 300


def test_quantiles_by_ranked_counts(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    groups = {"a": [float(v) for v in rng.integers(0, 30, 500)], "b": [2.5], "c": [], "d": [1.0, 2.0]}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("a", None), ("c", None), (None, 3.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    out = {r.g: r for r in R.describe_by(df, "g", "v").collect()}
    assert set(out) == {"a", "b", "c", "d"} and out["c"]["count"] == 0 and out["c"].p50 is None
    for g in ("a", "b", "d"):
        v = np.array(groups[g])
        assert out[g]["count"] == len(v) and abs(out[g]["mean"] - v.mean()) < 1e-9
        assert np.allclose([out[g]["min"], out[g].p25, out[g].p50, out[g].p75, out[g]["max"]], np.percentile(v, [0, 25, 50, 75, 100]))
        assert out[g]["std"] is None if len(v) == 1 else abs(out[g]["std"] - v.std(ddof=1)) < 1e-9
    box = {r.g: r for r in S.box_stats(df, "g", "v").collect()}
    assert set(box) == {"a", "b", "d"} and box["b"].q1 == 2.5 and box["b"].n_outliers == 0
    assert R.describe_by(df.limit(0), "g", "v").count() == 0
    assert "percentile" not in R.describe_by(df, "g", "v")._jdf.queryExecution().toString()


def test_category_positions_over_many_parts(spark):
    df = spark.range(3000).select(F.concat(F.lit("v"), F.lpad((F.col("id") * 7 % 500).cast("string"), 3, "0")).alias("g"))
    got = {r.g: r.code for r in cleanup.category_codes(df, "g", "code").distinct().collect()}
    assert got == {f"v{i:03d}": i for i in range(500)}


def test_modes_of_typed_columns(spark):
    data = [(D(2009, 1, 2), True, "b", 1.0), (D(2009, 1, 1), False, "a", None), (D(2009, 1, 2), None, "a", 3.0),
            (D(2009, 1, 1), True, "b", None), (None, None, None, None)]
    df = spark.createDataFrame(data, "d date, f boolean, s string, x double")
    assert cleanup.impute_values(df) == {"d": D(2009, 1, 1), "f": True, "s": "a", "x": 2.0}
    filled = cleanup.impute_mean_mode(df)
    assert filled.schema["d"].dataType.simpleString() == "date"
    assert filled.where("d is null or f is null or s is null or x is null").count() == 0
    assert cleanup.impute_values(df.limit(0)) == {}


def test_density_merges_batches(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    groups = {"a": rng.normal(size=400), "b": rng.integers(0, 5, 300).astype(float)}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("one", 1.0), ("a", None), (None, 2.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    got = {}
    for r in S.density(df, "v", "g", grid=20).collect():
        got.setdefault(r.g, {})[r.point] = (r.x, r.density)
    assert set(got) == {"a", "b", "one"} and all(d is None for _, d in got["one"].values())
    for g, v in groups.items():
        bw = v.std(ddof=1) * len(v) ** -0.2
        grid = np.linspace(v.min(), v.max(), 20)
        want = np.exp(-0.5 * ((grid[:, None] - v[None, :]) / bw) ** 2).sum(axis=1) / (len(v) * bw * math.sqrt(2 * math.pi))
        assert np.allclose([got[g][i] for i in range(20)], np.stack([grid, want], axis=1))
