"""Boosted trees without cached node ids: the same trees, and memory left to Spark ML's own copy of the rows."""

from pyspark.ml.classification import GBTClassifier
from pyspark.sql import functions as F

from claimscope.operators import models as MO


def test_boosted_trees_need_no_cached_node_ids(spark):
    df = spark.range(400).select(F.col("id").alias("a"), (F.col("id") * 7 % 31).alias("b"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    model = MO.fit_gbt(df, ["a", "b"], "y", rounds=4, depth=4)
    assert not model.getOrDefault("cacheNodeIds")
    with MO.training_input(df, ["a", "b"], "y") as data:
        assert data.storageLevel.useDisk and not data.storageLevel.useMemory
        old = GBTClassifier(featuresCol="features", labelCol="y", maxIter=4, maxDepth=4, stepSize=0.3, seed=MO.SEED,
                            maxMemoryInMB=1024, cacheNodeIds=True).fit(data)
    assert [t.toDebugString.split("\n")[1:] for t in old.trees] == [t.toDebugString.split("\n")[1:] for t in model.trees]
