"""Operator 12: the shuffle is a permutation, is reproducible and can be worked out both ways."""

import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from claimscope.llm import sharding as S
from claimscope.llm.common import numbered


@pytest.mark.parametrize("n", [1, 3, 1000])
def test_permutation_and_inverse(spark, n):
    a, b = S.sides(n)
    assert a * b >= n and a * b - n < a
    there = S.walked(spark.range(n).withColumnRenamed("id", "p").withColumn("row", F.col("p")), "p", n)
    rows = sorted((r.row, r.p) for r in there.collect())
    assert [r for r, _ in rows] == list(range(n)) and sorted(p for _, p in rows) == list(range(n))
    places = there.select((F.col("p") % 7).alias("__cs_shard"), F.expr("p div 7").alias("__cs_slot"), "row")
    assert all(r["__cs_row"] == r["row"] for r in S.row_numbers(places, n, shards=7).collect())
    if n >= 99:
        assert sum(abs(r - p) < n / 10 for r, p in rows) < n / 2  # it does shuffle


def _digest(rows):
    return sorted((r["doc_id"], r["__cs_size"], r["__cs_crc"], r["__cs_shard"], r["__cs_slot"]) for r in rows)


def test_odd_rows(docs_of):
    texts = [(1, None), (1, ""), (2, "é"), (2, "é"), (7, "x" * 300_000), *[(9, "copy")] * 50, *[(k, f"text {k}") for k in range(100, 160)]]
    df = docs_of(texts).unionByName(docs_of([(0, "t")]).withColumn("doc_id", F.lit(None).cast("long")))
    got = S.sharded(df).collect()
    by = {}
    for r in got:
        by.setdefault(r["__cs_shard"], []).append(r["__cs_slot"])
    assert len(got) == len(texts) + 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert set(by) == set(range(40)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    want = sorted((i or -1, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in [*texts, (None, "t")])
    assert sorted((r["doc_id"] or -1, r["__cs_size"], r["__cs_crc"]) for r in got) == want
    # the same whatever the partitions
    again = S.sharded(df.where("doc_id is not null").repartition(7)).collect()
    assert _digest(again) == _digest(S.sharded(df.where("doc_id is not null").coalesce(1)).collect())


def test_empty_table_and_few_rows(docs_of, spark):
    assert S.sharded(docs_of([(1, "a")]).where("doc_id < 0")).collect() == []
    assert sorted(r["__cs_slot"] for r in S.sharded(docs_of([(1, "a"), (2, "b")])).collect()) == [0, 0]


def test_numbers_follow_the_order(spark):
    df = spark.createDataFrame([(k * 7919 % 1000 // 3, "n") for k in range(1000)] + [(None, "n")] * 3, "k long, __cs_part string")
    rows = numbered(df.select("k"), ["k"], "test").collect()
    assert sorted(r["__cs_row"] for r in rows) == list(range(1003))
    in_order = [r["k"] for r in sorted(rows, key=lambda r: r["__cs_row"])]
    assert in_order == [None] * 3 + sorted(x for x in in_order if x is not None)


def test_written_shards(docs_of, spark, tmp_path):
    docs = docs_of([(k, f"text {k}") for k in range(200)])
    S.write_shards(docs, str(tmp_path / "out"), shards=8)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 200 and set(docs.columns) <= set(back.columns)
    place = {r["doc_id"]: (r["__cs_shard"], r["__cs_slot"]) for r in S.sharded(docs, shards=8).collect()}
    assert {r["doc_id"]: (r["__cs_shard"], r["__cs_slot"]) for r in back.collect()} == place


def test_query_equals_duckdb_without_python(spark, sf_small):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf_small}/documents.parquet'")
    df = S.op12_sharding(spark, sf_small)
    assert "Python" not in df._jdf.queryExecution().toString() and "Arrow" not in df._jdf.queryExecution().toString()
    assert sorted(map(tuple, df.collect())) == sorted(con.sql(S.OP12_SQL).fetchall())
