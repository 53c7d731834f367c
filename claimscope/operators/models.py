"""Model fitting and prediction with Spark ML.

Estimators train on executors (tree aggregation); the driver holds only
coefficients / trees.  Predictions are DataFrames keyed by RowID with the
label, the 0/1 prediction and the positive-class score.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from multiprocessing.pool import ThreadPool

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimscope.functions.values import SEED
from claimscope.operators import boosting
from claimscope.operators.metrics import binary_metrics, roc_auc
from claimscope.session import ensure_checkpoint_dir

LABEL = "FraudLabel"
MAX_DEPTH = 30
#: Rows up to which Spark ML's own trainer of boosted trees is quick.
LONG_ROWS = 250_000


def assemble(df: DataFrame, features: Sequence[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid="keep").transform(
        df.withColumns({c: F.col(c).cast("double") for c in features})
    )


@contextmanager
def training_input(df: DataFrame, features: Sequence[str], label: str) -> Iterator[DataFrame]:
    """Assembled training rows, kept on local disk for the passes before Spark
    ML makes its own copy of them, and released after it."""
    data = assemble(df, features).select(label, "features").persist(StorageLevel.DISK_ONLY)
    try:
        yield data
    finally:
        data.unpersist()


# M7
def fit_logistic(train: DataFrame, features: Sequence[str], label: str = LABEL, max_iter: int = 1000,
                 c: float = 1.0):
    """L2 logistic regression with the objective of C-regularised
    least-log-loss on unscaled features: regParam = 1 / (C n)."""
    with training_input(train, features, label) as data:
        lr = LogisticRegression(featuresCol="features", labelCol=label, maxIter=max_iter,
                                regParam=1.0 / (c * data.count()), elasticNetParam=0.0, standardization=False,
                                fitIntercept=True)
        return lr.fit(data)


# M8
def fit_gbt(train: DataFrame, features: Sequence[str], label: str = LABEL, rounds: int = 100, depth: int = 6,
            rate: float = 0.3, subsample: float = 1.0, col_sample: float = 1.0, seed: int = SEED):
    """Gradient-boosted trees (logistic loss).  Defaults are the boosting
    library's defaults the reference relies on (100 rounds, depth 6, rate 0.3).
    More than ``LONG_ROWS`` rows are trained on in blocks (see ``boosting``)."""
    strategy = "all" if col_sample >= 1.0 else str(col_sample)
    gbt = GBTClassifier(featuresCol="features", labelCol=label, maxIter=rounds, maxDepth=depth, stepSize=rate,
                        subsamplingRate=subsample, featureSubsetStrategy=strategy, seed=seed,
                        maxMemoryInMB=1024, cacheNodeIds=False)  # walking down a shallow tree is cheaper
    known = F.col(label).isin(0, 1)
    rows, labelled = train.agg(F.count(F.lit(1)), F.count_if(known)).first()
    if rows > LONG_ROWS and rows == labelled:
        return boosting.fit(gbt, train, features, rows)
    with training_input(train, features, label) as data:
        return gbt.fit(data)


# M9
def fit_rf(train: DataFrame, features: Sequence[str], label: str = LABEL, trees: int = 100,
           depth: int = MAX_DEPTH, seed: int = SEED):
    """Random forest.  Spark grows trees to a depth of at most 30, so a depth
    must be given and may not exceed that."""
    if not 1 <= depth <= MAX_DEPTH:
        raise ValueError(f"depth must be between 1 and {MAX_DEPTH}: deeper or unlimited trees are not supported")
    rf = RandomForestClassifier(featuresCol="features", labelCol=label, numTrees=trees,
                                maxDepth=depth, seed=seed, maxMemoryInMB=1024, cacheNodeIds=True)
    with training_input(train, features, label) as data:
        return rf.fit(data)


def predict(model, df: DataFrame, features: Sequence[str], label: str = LABEL, key: str = "RowID") -> DataFrame:
    out = model.transform(assemble(df, features))
    return out.select(
        key, F.col(label).cast("int").alias("label"), F.col("prediction").cast("int").alias("prediction"),
        vector_to_array("probability")[1].alias("score"),
    )


# M10
def feature_importance(spark: SparkSession, model, names: Sequence[str], k: int | None = 20) -> DataFrame:
    """Importances of a tree model as (Feature, Importance), top k (all if
    ``k`` is None)."""
    rows = [(n, float(v)) for n, v in zip(names, model.featureImportances.toArray(), strict=True)]
    df = spark.createDataFrame(rows, "Feature string, Importance double")
    return df if k is None else df.orderBy(F.desc("Importance"), "Feature").limit(k)


# M13
def cross_validate(df: DataFrame, features: Sequence[str], fit: Callable, folds_col: str = "fold", k: int = 5,
                   label: str = LABEL) -> DataFrame:
    """Train on k-1 folds, score the held-out fold, for every fold; returns
    the per-fold metrics (accuracy, precision, recall, F1, AUC) and, as
    fold = -1, their mean."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)

    def one(f: int) -> DataFrame:
        model = fit(df.where(F.col(folds_col) != f), features, label)
        pred = predict(model, df.where(F.col(folds_col) == f), features, label).checkpoint()
        return _fold_metrics(pred).withColumn("fold", F.lit(f))

    # the folds' fits are independent jobs over the same input; run side by side they fill each other's gaps
    with ThreadPool(k) as pool:
        parts = pool.map(inheritable_thread_target(spark)(one), range(k))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    mean = out.agg(*[F.avg(c).alias(c) for c in ("accuracy", "precision", "recall", "f1", "auc")]).withColumn(
        "fold", F.lit(-1)
    )
    return out.unionByName(mean)


def _fold_metrics(pred: DataFrame) -> DataFrame:
    bm = binary_metrics(pred)
    auc = roc_auc(pred).select("auc").scalar()
    return bm.withColumn("auc", auc)
