"""Split, folds and row ids: rows worked out once, ranks and copies as plain Python has them."""

import hashlib

import pytest
from pyspark.sql import functions as F

from claimscope.functions.values import SEED
from claimscope.operators import features as FE
from claimscope.operators.ranking import hash_cut
from claimscope.operators.windows import with_row_id
from claimscope.session import saved


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def base(spark):
    rows = [(f"r{i}", None if i % 41 == 0 else int(i % 7 == 0), i) for i in range(700)]
    return spark.createDataFrame(rows, "RowID string, FraudLabel int, v int").repartition(5)


def ranks(base):
    found = {}
    for label in (0, 1):
        ids = [r.RowID for r in base.collect() if r.FraudLabel == label]
        found[label] = sorted(ids, key=lambda x: md5(f"{SEED}|{x}"))
    return found


def test_split_and_folds_follow_the_hash_order(base):
    want = ranks(base)
    split = FE.stratified_split(base)
    plan = split._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.count("Relation") == 1  # read from the written rows, nothing ranked again
    got = {r.RowID: r.is_test for r in split.collect()}
    assert len(got) == 700
    test = {x for ids in want.values() for x in ids[: -(-len(ids) * 20 // 100)]}
    assert {x for x, flag in got.items() if flag} == test
    fold = {x: i % 5 for ids in want.values() for i, x in enumerate(ids)}
    assert {r.RowID: r.fold for r in FE.stratified_folds(base).collect()} == fold


def test_hash_cut_with_few_buckets(base):
    hashed = base.withColumn("_h", F.md5(F.concat_ws("|", F.lit(str(SEED)), "RowID")))
    want = ranks(base)
    for cut in (1, 50, 80):
        got = {r.FraudLabel: r._h for r in hash_cut(hashed, "FraudLabel", "_h", F.lit(cut), bits=4).collect()}
        assert got == {x: md5(f"{SEED}|{ids[cut - 1]}") for x, ids in want.items()}


def test_row_ids_of_copies_and_of_rows_with_one_text(spark):
    rows = [("a", "x"), ("a", "x"), ("a", None), ("a", "␀"), ("b|c", "d"), ("b", "c|d"), ("e", "f")]
    got = [r.RowID for r in with_row_id(spark.createDataFrame(rows, "p string, q string")).collect()]
    texts = ["a|x|1", "a|x|2", "a|␀|1", "a|␀|2", "b|c|d|1", "b|c|d|2", "e|f|1"]
    assert sorted(got) == sorted(map(md5, texts))


def test_saved_keeps_rows_and_columns(spark):
    df = spark.createDataFrame([(1, None, [1.5]), (2, "x", None)], "a int, b string, c array<double>")
    out = saved(df)
    assert out.columns == df.columns and sorted(map(tuple, out.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    assert saved(df.where("a > 5")).count() == 0


def test_features_b_are_worked_out_once(spark, monkeypatch):
    from claimscope.plans import model_queries as MQ

    rows = [("r1", "Yes", "12", None, 3), ("r2", None, "x", 2.5, None)]
    own = spark.createDataFrame(rows, "RowID string, PotentialFraud string, State string, ratio double, Race int")
    monkeypatch.setattr(MQ, "claims", lambda spark, d: own)
    out = MQ.m02_features_b(spark, "")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Project" not in plan and plan.count("Relation") == 1  # only written rows are read
    got = {r.RowID: r.asDict() for r in out.collect()}
    assert got["r1"] == {"RowID": "r1", "FraudLabel": 1, "State": 12.0, "ratio": 0.0, "Race": 3.0}
    assert got["r2"] == {"RowID": "r2", "FraudLabel": None, "State": 0.0, "ratio": 2.5, "Race": 0.0}


def test_row_ids_with_many_repeated_rows_shuffle_few(spark, monkeypatch):
    """More repeated rows than are broadcast: the ids of before, and rows whose bit is not set are not joined by a shuffle."""
    from claimscope.operators import windows

    df = spark.range(4000).select((F.col("id") % 3700).alias("n"), F.when(F.col("id") % 5 > 0, F.col("id") % 100).cast("string").alias("t"))
    want = sorted(map(tuple, windows.with_row_id(df).collect()), key=str)
    monkeypatch.setattr(windows, "BROADCAST_ROWS", 10)
    got = windows.with_row_id(df)
    assert sorted(map(tuple, got.collect()), key=str) == want and len({r[-1] for r in want}) == 4000
    values = spark.range(0, 60_000, 7).select((F.xxhash64("id")).alias("_s"))
    rows = spark.range(60_000).select(F.col("id"), F.xxhash64("id").alias("_s"))
    marked = {r.id: r._marked for r in windows._marked(rows, "_s", values).collect()}
    assert all(marked[i] for i in range(0, 60_000, 7))
    assert sum(marked.values()) < 8572 + 50  # about two of a hundred thousand by chance


def test_join_on_row_id_keys_the_rows_once(spark, sf_small):
    from claimscope.plans.registry import queries

    plan = queries()["j09_join_on_row_id"](spark, sf_small)._jdf.queryExecution().optimizedPlan().toString()
    assert "lineitem" not in plan and "l_orderkey" not in plan and plan.count("Relation") == 2


def test_claims_of_variant_d_are_keyed_once(spark, sf_small, monkeypatch):
    from claimscope.plans import model_queries as MQ

    seen = []
    monkeypatch.setattr(MQ.TX, "tfidf", lambda docs, *a, **k: seen.append(docs) or docs)
    monkeypatch.setattr(MQ.TX, "svd_topics", lambda w, key, n: w.select(key, F.length("DiagDoc").cast("double").alias("DiagTopic_1")))
    plans = [MQ.m04_features_d(spark, sf_small), seen[0], MQ.topics(spark, sf_small), seen[1]]
    for df in plans:  # the claims' join is behind them
        assert "l_orderkey" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert plans[0].count() == MQ.m04_features_d_base(spark, sf_small).count() > 0
