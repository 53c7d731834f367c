"""Classification metrics as aggregations over a prediction table.

All are exact: counts are integers and each metric is one division at the
end, so they can be checked against SQL.  The ROC running sums use the
bucketed prefix sum (no single-partition window over the scores).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimscope.operators.ranking import descending_prefix_sums

CLASSES = [0, 1]


# M11
def confusion(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Complete 2 x 2 table (zero cells included)."""
    counts = pred.groupBy(F.col(label).cast("int").alias("label"), F.col(prediction).cast("int").alias("prediction")).agg(
        F.count(F.lit(1)).alias("count")
    )
    spark = pred.sparkSession
    cells = spark.createDataFrame([(a, b) for a in CLASSES for b in CLASSES], "label int, prediction int")
    out = F.broadcast(cells).join(counts, ["label", "prediction"], "left")  # 4-row table
    return out.select("label", "prediction", F.coalesce("count", F.lit(0)).cast("bigint").alias("count"))


def _cell(lbl: int, prd: int):
    return F.count_if((F.col("_l") == lbl) & (F.col("_p") == prd))


def classification_report(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Per-class precision / recall / F1 / support, accuracy, macro and
    support-weighted averages; 0 where a denominator is 0."""
    base = pred.select(F.col(label).cast("int").alias("_l"), F.col(prediction).cast("int").alias("_p"))
    m = base.agg(_cell(0, 0).alias("c00"), _cell(0, 1).alias("c01"), _cell(1, 0).alias("c10"), _cell(1, 1).alias("c11"))

    def ratio(a, b):
        return F.when(b == 0, F.lit(0.0)).otherwise(a / b)

    def f1(p, r):
        return F.when(p + r == 0, F.lit(0.0)).otherwise(2 * p * r / (p + r))

    c00, c01, c10, c11 = (F.col(c) for c in ("c00", "c01", "c10", "c11"))
    p0, r0 = ratio(c00, c00 + c10), ratio(c00, c00 + c01)
    p1, r1 = ratio(c11, c11 + c01), ratio(c11, c11 + c10)
    s0, s1 = c00 + c01, c10 + c11
    n = s0 + s1
    rows = m.select(
        p0.alias("p0"), r0.alias("r0"), f1(p0, r0).alias("f0"), s0.alias("s0"),
        p1.alias("p1"), r1.alias("r1"), f1(p1, r1).alias("f1"), s1.alias("s1"),
        ratio(c00 + c11, n).alias("acc"), n.alias("n"),
    )
    P, R, Fc, S = (lambda k: F.col(f"p{k}")), (lambda k: F.col(f"r{k}")), (lambda k: F.col(f"f{k}")), (lambda k: F.col(f"s{k}"))
    entries = [
        F.struct(F.lit("0").alias("row"), P(0).alias("precision"), R(0).alias("recall"), Fc(0).alias("f1"), S(0).alias("support")),
        F.struct(F.lit("1").alias("row"), P(1).alias("precision"), R(1).alias("recall"), Fc(1).alias("f1"), S(1).alias("support")),
        F.struct(F.lit("accuracy").alias("row"), F.lit(None).cast("double").alias("precision"),
                 F.lit(None).cast("double").alias("recall"), F.col("acc").alias("f1"), F.col("n").alias("support")),
        F.struct(F.lit("macro avg").alias("row"), ((P(0) + P(1)) / 2).alias("precision"), ((R(0) + R(1)) / 2).alias("recall"),
                 ((Fc(0) + Fc(1)) / 2).alias("f1"), F.col("n").alias("support")),
        F.struct(F.lit("weighted avg").alias("row"), ratio(P(0) * S(0) + P(1) * S(1), F.col("n")).alias("precision"),
                 ratio(R(0) * S(0) + R(1) * S(1), F.col("n")).alias("recall"),
                 ratio(Fc(0) * S(0) + Fc(1) * S(1), F.col("n")).alias("f1"), F.col("n").alias("support")),
    ]
    out = rows.select(F.inline(F.array(*entries)))
    return out.withColumn("support", F.col("support").cast("bigint"))


def binary_metrics(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row: accuracy, precision, recall, F1 of the positive class."""
    base = pred.select(F.col(label).cast("int").alias("_l"), F.col(prediction).cast("int").alias("_p"))
    m = base.agg(_cell(0, 0).alias("tn"), _cell(0, 1).alias("fp"), _cell(1, 0).alias("fn"), _cell(1, 1).alias("tp"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    prec = F.when(tp + fp == 0, 0.0).otherwise(tp / (tp + fp))
    rec = F.when(tp + fn == 0, 0.0).otherwise(tp / (tp + fn))
    return m.select(
        ((tp + tn) / (tp + tn + fp + fn)).alias("accuracy"), prec.alias("precision"), rec.alias("recall"),
        F.when(prec + rec == 0, 0.0).otherwise(2 * prec * rec / (prec + rec)).alias("f1"),
    )


def _score_counts(pred: DataFrame, label: str, score: str) -> DataFrame:
    base = pred.select(F.col(label).cast("int").alias("_l"), F.col(score).cast("double").alias("score"))
    return base.where(F.col("score").isNotNull() & F.col("_l").isNotNull()).groupBy("score").agg(
        F.count_if(F.col("_l") == 1).alias("pos"), F.count_if(F.col("_l") == 0).alias("neg")
    )


# M12
def roc_curve(pred: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """One point per distinct score (descending thresholds) plus the origin
    (threshold +inf): fpr, tpr, threshold."""
    cum = descending_prefix_sums(_score_counts(pred, label, score), "score", ["pos", "neg"])
    tot = cum.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    P, N = tot.select("P").scalar(), tot.select("N").scalar()
    pts = cum.select(
        (F.col("cum_neg") / N).alias("fpr"), (F.col("cum_pos") / P).alias("tpr"), F.col("score").alias("threshold")
    )
    origin = pts.sparkSession.range(1).select(
        F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"), F.lit(float("inf")).alias("threshold")
    )
    return origin.unionByName(pts)


def roc_auc(pred: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Exact AUC (ties count one half) = sum over scores of
    neg * (2 * positives ranked strictly higher + pos) / (2 P N)."""
    cum = descending_prefix_sums(_score_counts(pred, label, score), "score", ["pos"])
    higher = F.col("cum_pos") - F.col("pos")
    wide = lambda c: c.cast("decimal(19,0)")  # noqa: E731  the product of two counts can exceed 64 bits
    agg = cum.agg(
        F.sum((wide(F.col("neg")) * wide(2 * higher + F.col("pos"))).cast("decimal(38,0)")).alias("num"),
        F.sum("pos").alias("P"), F.sum("neg").alias("N"),
    )
    pairs = 2.0 * F.col("P") * F.col("N")
    return agg.select((F.col("num").cast("double") / pairs).alias("auc"))
