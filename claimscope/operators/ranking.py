"""Exact ranks and running sums without a single-partition window.

A window ``partitionBy(label).orderBy(x)`` puts a whole class into one task.
Instead the ordering key is cut into at most ``2**bits`` buckets that
preserve order; a bucket histogram (bounded size) gives each bucket's
offset, and only the rows of one bucket are ordered together.  The result is
the exact rank / running sum.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimscope.session import ensure_checkpoint_dir

DEFAULT_BITS = 20


def seeded_hash(cols: Sequence[str | Column], seed: int) -> Column:
    """md5(seed | cols...) as hex text: a reproducible pseudo-random order."""
    parts = [F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")) for c in cols]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *parts))


def hash_rank(df: DataFrame, strata: Sequence[str], hash_col: str, name: str = "rank",
              bits: int = DEFAULT_BITS, size_col: str | None = None) -> DataFrame:
    """1-based rank of each row within its stratum, ordered by the hex text in
    ``hash_col`` (ties between identical hashes broken arbitrarily: such rows
    are copies of each other).  ``size_col`` also adds the stratum size."""
    strata = list(strata)
    hexdigits = max(1, bits // 4)
    bucket = F.conv(F.substring(F.col(hash_col), 1, hexdigits), 16, 10).cast("long")
    tagged = df.withColumn("_b", bucket)
    hist = tagged.groupBy(*strata, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*strata).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    extra = [F.sum("_n").over(Window.partitionBy(*strata)).alias(size_col)] if size_col else []
    offsets = hist.select(*strata, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"), *extra)
    joined = tagged.join(offsets, on=[*strata, "_b"], how="inner")
    within = Window.partitionBy(*strata, "_b").orderBy(hash_col)
    return joined.withColumn(name, F.col("_off") + F.row_number().over(within)).drop("_b", "_off")


def hash_cut(df: DataFrame, stratum: str, hash_col: str, cut: Column, bits: int = DEFAULT_BITS) -> DataFrame:
    """(stratum, hash): the hex text at rank ``cut`` (an expression of ``_n``,
    the stratum's size) of each stratum.  The bucket histogram tells the bucket
    that holds the rank; only its rows are ordered.  Null strata have no row."""
    bucket = F.conv(F.substring(F.col(hash_col), 1, max(1, bits // 4)), 16, 10).cast("long")
    tagged = df.where(F.col(stratum).isNotNull()).select(stratum, hash_col, bucket.alias("_b"))
    hist = tagged.groupBy(stratum, "_b").agg(F.count(F.lit(1)).alias("_c"))
    upto = Window.partitionBy(stratum).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    place = hist.withColumns({"_n": F.sum("_c").over(Window.partitionBy(stratum)), "_to": F.sum("_c").over(upto)})
    place = place.withColumn("_cut", cut).where((F.col("_cut") > F.col("_to") - F.col("_c")) & (F.col("_cut") <= F.col("_to")))
    place = place.select(stratum, "_b", (F.col("_cut") - F.col("_to") + F.col("_c")).alias("_at"))
    rows = tagged.join(F.broadcast(place), [stratum, "_b"])  # one bucket a stratum
    within = Window.partitionBy(stratum).orderBy(hash_col)
    return rows.withColumn("_rn", F.row_number().over(within)).where(F.col("_rn") == F.col("_at")).select(stratum, hash_col)


def descending_prefix_sums(df: DataFrame, score: str, values: Sequence[str]) -> DataFrame:
    """For a table with one row per distinct ``score``, add ``cum_<v>`` = sum
    of ``v`` over all rows with a score >= this row's (descending running
    sum), exactly.

    The scores are range-partitioned, so the number of parts follows the
    data; a running sum inside each part starts from the sum of all parts
    before it (a table of one row a part).  Both tables are checkpointed: the
    bounds of the ranges are sampled, so they must be drawn only once."""
    values = list(values)
    ensure_checkpoint_dir(df.sparkSession)
    ranged = df.checkpoint().repartitionByRange(F.desc(score)).withColumn("_b", F.spark_partition_id()).checkpoint()
    hist = ranged.groupBy("_b").agg(*[F.sum(v).alias(f"_h_{v}") for v in values])
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = hist.select("_b", *[F.coalesce(F.sum(f"_h_{v}").over(before), F.lit(0)).alias(f"_o_{v}") for v in values])
    joined = ranged.join(F.broadcast(offsets), on="_b", how="inner")
    within = Window.partitionBy("_b").orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    return joined.select(
        *df.columns, *[(F.col(f"_o_{v}") + F.sum(v).over(within)).alias(f"cum_{v}") for v in values]
    )


def ranked_counts(df: DataFrame, key: str, value: str) -> DataFrame:
    """One row per (key, distinct non-null value): ``n`` rows have it, they
    take the 0-based ranks ``lo`` to ``hi`` - 1 of the key's ``total``
    non-null values in ascending order.  Null values keep a row without ranks.

    The rows are counted with partial aggregation; the counts are
    range-partitioned by (key, value), so a key with very many values lies in
    many parts, and a part starts from the sum of the key's parts before it."""
    ensure_checkpoint_dir(df.sparkSession)
    counts = df.groupBy(F.col(key).alias("key"), F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("n")).checkpoint()
    ranged = counts.where(F.col("value").isNotNull()).repartitionByRange("key", "value")
    ranged = ranged.withColumn("_b", F.spark_partition_id()).checkpoint()
    hist = ranged.groupBy("key", "_b").agg(F.sum("n").alias("_n"))
    before = Window.partitionBy("key").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = hist.select("key", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"),
                          F.sum("_n").over(Window.partitionBy("key")).alias("total"))
    within = Window.partitionBy("key", "_b").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    ranks = ranged.join(offsets, ["key", "_b"]).withColumn("hi", F.col("_off") + F.sum("n").over(within))
    ranks = ranks.select("key", "value", "n", (F.col("hi") - F.col("n")).alias("lo"), "hi", "total")
    rest = counts.where(F.col("value").isNull())
    return ranks.unionByName(rest, allowMissingColumns=True).checkpoint()


def quantiles(ranks: DataFrame, probs: Sequence[float]) -> DataFrame:
    """(key, q0, q1, ...): exact quantiles with linear interpolation from
    ``ranked_counts``; null for a key without values."""
    aggs, picks = [], []
    for i, p in enumerate(probs):
        pos = F.lit(float(p)) * (F.col("total") - 1)
        value = F.col("value").cast("double")
        for side, rank in (("l", F.floor(pos)), ("u", F.ceil(pos))):
            aggs.append(F.max(F.when((F.col("lo") <= rank) & (rank < F.col("hi")), value)).alias(f"_{side}{i}"))
        share = pos - F.floor(pos)
        picks.append((F.col(f"_l{i}") * (1 - share) + F.col(f"_u{i}") * share).alias(f"q{i}"))
    return ranks.groupBy("key").agg(*aggs, F.max("total").alias("total")).select("key", *picks)


def positions(levels: DataFrame, col: str, name: str) -> DataFrame:
    """Add ``name``, the 0-based position of each of the distinct non-null
    values of ``col``: numbered inside range parts, each starting from the
    sizes of the parts before it (one row a part)."""
    ensure_checkpoint_dir(levels.sparkSession)
    ranged = levels.checkpoint().repartitionByRange(col).withColumn("_b", F.spark_partition_id()).checkpoint()
    sizes = ranged.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.agg(F.sort_array(F.collect_list(F.struct("_b", "_n"))).alias("_all"))
    first = F.aggregate(F.filter("_all", lambda p: p["_b"] < F.col("_p._b")), F.lit(0).cast("bigint"), lambda s, p: s + p["_n"])
    first = sizes.select("_all", F.explode("_all").alias("_p")).select(F.col("_p._b").alias("_b"), first.alias("_off"))
    place = F.row_number().over(Window.partitionBy("_b").orderBy(col)) - 1
    return ranged.join(F.broadcast(first), "_b").withColumn(name, F.col("_off") + place).drop("_b", "_off")
