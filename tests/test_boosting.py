"""Boosted trees on long tables: the trees of Spark ML's trainer, from every row, whatever their parts."""

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.sql import functions as F

from claimscope.operators import boosting as BO
from claimscope.operators import explain as E
from claimscope.operators import models as MO

NAMES = ["a", "b", "c", "d", "e"]


@pytest.fixture(scope="module")
def rows(spark):
    h = lambda k: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1_000_003)) / 1_000_003.0
    df = spark.range(3000).select(F.col("id").cast("string").alias("RowID"), h(1).alias("a"), F.floor(h(2) * 8).alias("b"), F.floor(h(3) * 50).alias("c"),
                                  (h(4) > 0.3).cast("int").alias("d"), F.exp(h(1)).alias("e"), h(9).alias("n"))
    signal = F.col("a") * 2 + F.col("b") / 8 + F.col("d") * F.col("c") / 50 + F.col("n")
    return df.withColumn("y", (signal > 2.2).cast("int")).cache()


def in_blocks(monkeypatch, rows, **settings):
    monkeypatch.setattr(MO, "LONG_ROWS", 0, raising=False)
    monkeypatch.setattr(MO.GBTClassifier, "fit", lambda *a: pytest.fail("a long table was given to Spark ML's trainer"))
    return MO.fit_gbt(rows, NAMES, "y", **settings)


def test_same_trees_as_spark_ml(spark, rows, monkeypatch):
    want = MO.fit_gbt(rows, NAMES, "y", rounds=6, depth=4)
    monkeypatch.setattr(BO, "CHECKPOINT_ROUNDS", 2, raising=False)
    monkeypatch.setattr(BO, "BLOCK_ROWS", 500, raising=False)
    got = in_blocks(monkeypatch, rows, rounds=6, depth=4)
    assert got.treeWeights == want.treeWeights and got.numFeatures == 5
    assert [t.numNodes for t in got.trees] == [t.numNodes for t in want.trees]
    assert np.allclose(got.featureImportances.toArray(), want.featureImportances.toArray(), atol=1e-9)
    scores = MO.predict(got, rows, NAMES, "y").join(MO.predict(want, rows, NAMES, "y").withColumnRenamed("score", "s"), "RowID")
    assert scores.agg(F.max(F.abs(F.col("score") - F.col("s")))).first()[0] < 1e-9
    contrib, base = E.tree_contributions(got, rows.limit(20), NAMES)
    total = contrib.groupBy("RowID").agg((F.sum("value") + base).alias("total")).join(E.raw_margin(got, rows, NAMES), "RowID")
    assert total.agg(F.max(F.abs(F.col("total") - F.col("margin")))).first()[0] < 1e-9


def test_parts_do_not_matter_and_samples_count(rows, monkeypatch):
    one = in_blocks(monkeypatch, rows.coalesce(1), rounds=3, depth=3)
    monkeypatch.setattr(BO, "COLLECT_BYTES", 0, raising=False)  # tables added up by tasks
    many = in_blocks(monkeypatch, rows.repartition(7), rounds=3, depth=3)
    assert one.toDebugString.split("\n")[1:] == many.toDebugString.split("\n")[1:]
    root = lambda m, t: m.trees[t]._call_java("rootNode").impurityStats().count()
    assert root(one, 2) == 3000
    some = in_blocks(monkeypatch, rows, rounds=3, depth=3, subsample=0.8, col_sample=0.4)
    assert 2200 < root(some, 2) < 2600 and root(some, 1) != root(some, 2)


def test_odd_columns(spark, monkeypatch):
    df = spark.range(300).select(F.lit(7).alias("a"), F.when(F.col("id") % 3 > 0, F.col("id") % 5).alias("b"), F.lit(None).cast("double").alias("c"),
                                 F.lit(1).alias("d"), F.col("id").alias("e"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    model = in_blocks(monkeypatch, df, rounds=2, depth=3)
    assert model.featureImportances.toArray()[1] > 0.9 and set(model.featureImportances.indices) <= {1, 4}
    flat = in_blocks(monkeypatch, df.withColumn("y", F.lit(1)), rounds=2, depth=3)
    assert flat.trees[0].numNodes == 1 and flat.trees[0]._call_java("rootNode").prediction() == 1.0


def test_bins_of_groups():
    rng = np.random.default_rng(1)
    splits = [np.arange(rng.integers(1, 31)) + 0.5 for _ in range(12)] + [np.zeros(0)]
    bins = BO.Bins(splits)
    assert max(bins.width) <= BO.JOINT and sorted(f for g in bins.groups for f in g) == list(range(13))
    columns = [rng.integers(-1, 34, 400).astype(float) for _ in splits]
    joint = [np.bincount(c, minlength=w)[None, None] for c, w in zip(bins.codes(columns), bins.width)]
    found = bins.per_feature(joint)[0, 0]
    for f, (x, s) in enumerate(zip(columns, splits)):
        assert found[f].tolist() == np.bincount(np.searchsorted(s, x), minlength=max(bins.size)).tolist()


def test_other_labels_are_refused(spark, monkeypatch):
    monkeypatch.setattr(MO, "LONG_ROWS", 0, raising=False)
    df = spark.range(9).select(*[F.col("id").alias(c) for c in NAMES], F.col("id").cast("int").alias("y"))
    with pytest.raises(Exception):  # noqa: B017  Spark ML's own error
        MO.fit_gbt(df, NAMES, "y", rounds=1)
    assert GBTClassifier is MO.GBTClassifier
