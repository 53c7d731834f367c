"""Distribution summaries behind the reference's charts.

All are aggregations: per-group quantiles joined back to the values for the
whisker pass, global min/max as scalar subqueries for the histogram, and a
Gaussian kernel density evaluated on a fixed grid from the distinct values
(the values are first reduced to (value, weight)).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimscope.operators.ranking import quantiles, ranked_counts


def _keys(hue: str | None) -> list[str]:
    return [hue] if hue else []


# A24
def box_stats(df: DataFrame, key: str, value: str, whis: float = 1.5) -> DataFrame:
    """Quartiles (linear interpolation), whiskers at the most extreme data
    points within ``whis`` x IQR of the box, and the number of outliers, all
    from the ranked counts of distinct values (one read of ``df``)."""
    base = df.select(key, value).where(F.col(key).isNotNull() & F.col(value).isNotNull())
    ranks = ranked_counts(base, key, value)
    q = quantiles(ranks, [0.25, 0.5, 0.75]).select(
        "key", F.col("q0").alias("q1"), F.col("q1").alias("median"), F.col("q2").alias("q3"))
    iqr = F.col("q3") - F.col("q1")
    v = F.col("value")
    inside = (v >= F.col("q1") - whis * iqr) & (v <= F.col("q3") + whis * iqr)
    return ranks.join(q, "key").groupBy(F.col("key").alias(key), "q1", "median", "q3").agg(
        F.min(F.when(inside, v)).cast("double").alias("whisker_low"),
        F.max(F.when(inside, v)).cast("double").alias("whisker_high"),
        F.coalesce(F.sum(F.when(~inside, F.col("n"))), F.lit(0)).alias("n_outliers"),
    )


# A25
def histogram(df: DataFrame, value: str, bins: int, hue: str | None = None) -> DataFrame:
    """Equal-width histogram over [global min, global max]; the maximum falls
    in the last bin.  Output: bin (1-based), lower/upper edge, count."""
    base = df.select(value, *_keys(hue)).where(F.col(value).isNotNull())
    if hue:
        base = base.where(F.col(hue).isNotNull())
    ends = base.agg(F.struct(F.min(value).cast("double").alias("mn"), F.max(value).cast("double").alias("mx")).alias("m")).scalar()
    mn, mx = ends["mn"], ends["mx"]
    width = (mx - mn) / bins
    raw = F.floor((F.col(value).cast("double") - mn) / (mx - mn) * bins)
    b = F.when(mx == mn, F.lit(1)).otherwise(F.least(raw, F.lit(bins - 1)) + 1).cast("int")
    counts = base.groupBy(*_keys(hue), b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    return counts.select(
        *_keys(hue), "bin",
        (mn + (F.col("bin") - 1) * width).alias("lower"),
        (mn + F.col("bin") * width).alias("upper"),
        "count",
    )


# A26
def density(df: DataFrame, value: str, hue: str | None = None, grid: int = 200) -> DataFrame:
    """Gaussian kernel density on ``grid`` points spanning [min, max] of each
    hue group, bandwidth = sample std x n^(-1/5) (Scott's rule), normalised
    per group; null where a group has no spread.  The values are first reduced
    to (value, weight) pairs; an Arrow batch of pairs gives ``grid`` sums a
    group, which are merged, so no pair is multiplied before the shuffle."""
    keys = _keys(hue)
    base = df.select(F.col(value).cast("double").alias("x"), *keys).where(F.col(value).isNotNull())
    if hue:
        base = base.where(F.col(hue).isNotNull())
    weights = base.groupBy(*keys, "x").agg(F.count(F.lit(1)).alias("w"))
    stats = [F.count(F.lit(1)).alias("n"), F.stddev_samp("x").alias("sd"), F.min("x").alias("lo"), F.max("x").alias("hi")]
    if keys:
        params = base.groupBy(*keys).agg(*stats)
        j = weights.join(params, on=keys, how="inner")
    else:
        # one group: the parameters are one scalar subquery (no join needed)
        p = base.agg(F.struct(*stats).alias("p")).scalar()
        j = weights.withColumns({c: p[c] for c in ("n", "sd", "lo", "hi")})
    j = j.withColumn("bw", F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2)))

    j = j.select(*keys, "x", F.col("w").cast("double").alias("w"), "n", "bw", "lo", "hi")

    def batch_sums(batches):
        for batch in batches:
            # a group is told by its hue; its parameters are the same in all rows
            groups = batch.groupby(keys[0], sort=False) if keys else [(None, batch)]
            for _, rows in groups:
                first = rows.iloc[0]
                points = first["lo"] + np.arange(grid) * (first["hi"] - first["lo"]) / (grid - 1)
                sums = np.zeros(grid)
                with np.errstate(divide="ignore", invalid="ignore"):
                    for start in range(0, len(rows), 4096):
                        part = rows.iloc[start:start + 4096]
                        z = (points[None, :] - part["x"].to_numpy()[:, None]) / first["bw"]
                        sums += part["w"].to_numpy() @ np.exp(-0.5 * z * z)
                out = pd.DataFrame({"point": np.arange(grid, dtype="int32"), "_x": points, "_s": sums})
                yield out.assign(**{c: first[c] for c in [*keys, "n", "bw"]})[[*keys, "point", "_x", "_s", "n", "bw"]]

    hues = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in keys)
    sums = j.mapInPandas(batch_sums, f"{hues}point int, _x double, _s double, n bigint, bw double")
    out = sums.groupBy(*keys, "point").agg(F.first("_x").alias("x"), F.sum("_s").alias("_s"),
                                           F.first("n").alias("n"), F.first("bw").alias("bw"))
    norm = F.col("n") * F.col("bw") * math.sqrt(2 * math.pi)
    return out.select(*keys, "point", "x", F.try_divide(F.col("_s"), norm).alias("density"))
