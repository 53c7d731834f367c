"""What one task holds does not grow with the claims."""

from datetime import datetime

from pyspark.sql import functions as F

from claimscope.operators.windows import overlap_count, overlap_count_window
from claimscope.sources import fixture as fx


def test_join_in_parts_of_so_many_rows(spark, tmp_path, monkeypatch):
    """The claims' join has a part for every ``PART_ROWS`` rows, which Spark does not put together again, and the same rows."""
    day = datetime(1995, 3, 1)
    lines = [(i // 4 if i % 9 else None, i % 50 if i % 11 else None, i % 7, i % 5, float(i), "AN"[i % 2], day if i % 13 else None) for i in range(2000)]
    spark.createDataFrame(lines, "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_extendedprice double, l_returnflag string, "
                          "l_shipdate timestamp_ntz").write.parquet(f"{tmp_path}/lineitem.parquet")
    orders = [(k if k else None, k % 20 if k % 17 else None) for k in [*range(450), *range(50)]]
    spark.createDataFrame(orders, "o_orderkey bigint, o_custkey bigint").write.parquet(f"{tmp_path}/orders.parquet")
    rows = lambda df: sorted(map(str, df.collect()))
    before = rows(fx.claims_src(spark, str(tmp_path)))
    monkeypatch.setattr(fx, "PART_ROWS", 100, raising=False)
    claims = fx.claims_src(spark, str(tmp_path))
    assert claims.rdd.getNumPartitions() == 25
    assert rows(claims) == before and len(before) > 1700


def test_overlaps_counted_in_small_tasks(spark, monkeypatch):
    """Shuffle partitions are put together up to ``TASK_BYTES``, not up to Spark's 64 MB; settings stay."""
    from claimscope import session

    monkeypatch.setattr(session, "TASK_BYTES", "1m", raising=False)
    start = F.date_add(F.lit("2009-01-01").cast("date"), F.pmod(F.xxhash64("id"), F.lit(300)).cast("int"))
    claims = spark.range(0, 400_000, 1, 2).select(
        F.when(F.col("id") % 10 > 0, F.concat(F.lit("BENE"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(90_000)))).alias("BeneID"), start.alias("ClaimStartDt"),
        F.date_add(start, (F.col("id") % 25).cast("int")).alias("ClaimEndDt"), F.col("id").cast("string").alias("ClaimID"))
    want = overlap_count_window(claims).first()[0]
    first = "spark.sql.adaptive.coalescePartitions.parallelismFirst"
    spark.conf.set(first, "false")
    settings = dict(spark.conf.getAll)
    spark.sparkContext.setJobGroup("small tasks", "")
    try:
        assert overlap_count(claims).first()[0] == want > 0
        assert dict(spark.conf.getAll) == settings
        tracker = spark.sparkContext.statusTracker()
        stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("small tasks") for s in tracker.getJobInfo(j).stageIds]
        assert max(s.numTasks for s in stages if s) > 2
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        spark.conf.unset(first)
