"""Operator 12: reproducible shuffle into shards by a Feistel permutation of global row numbers.

Rows are numbered in the order of their id and text; the number goes through a Feistel network over the domain
[0, a*b) with a = ceil(sqrt(n)) and b = ceil(n/a), and place p of the shuffle is slot ``p div shards`` of shard
``p mod shards``.  So shard and slot follow from the row number alone (and the row number from them, ``row_numbers``),
and the shards' row counts differ by one at most.

Cycle walking: a number that the network sends to n or beyond goes through it again until it falls below n.  Only
the fewer than a = ceil(sqrt(n)) numbers from n to a*b can be met on the way, so their ends are worked out once, in a
table of that many rows, and joined.

Scale: only id, size and hashes travel, in one range shuffle; only DataFrame functions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimscope.llm.common import numbered, read_table, text_or_empty, written

SHARDS, ROUNDS, SEED, ROW_BYTES = 40, 6, 12, 16


def sides(n: int) -> tuple[int, int]:
    """The domain's factors: a*b >= n, and a*b - n < a."""
    a = max(1, math.isqrt(max(n, 1) - 1) + 1)
    return a, max(1, -(-n // a))


def _mixed(half: Column, turn: int, seed: int) -> Column:
    """60 bits from a half, a round and the seed."""
    text = F.concat(F.lit(f"{seed}:{turn}:"), half.cast("string"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def permuted(df: DataFrame, column: str, n: int, seed: int = SEED, inverse: bool = False) -> DataFrame:
    """``df`` with ``column``, a number below a*b, sent once through the network (or back)."""
    a, b = sides(n)
    x = F.col(column)
    df = df.withColumns({"__cs_l": F.expr(f"`{column}` div {b}"), "__cs_r": x % b})
    for turn in reversed(range(ROUNDS)) if inverse else range(ROUNDS):
        into, other, size = ("__cs_l", "__cs_r", a) if turn % 2 == 0 else ("__cs_r", "__cs_l", b)
        step = _mixed(F.col(other), turn, seed)
        df = df.withColumn(into, F.pmod(F.col(into) - step if inverse else F.col(into) + step, F.lit(size)))
    return df.withColumn(column, F.col("__cs_l") * b + F.col("__cs_r")).drop("__cs_l", "__cs_r")


def walked(df: DataFrame, column: str, n: int, seed: int = SEED, inverse: bool = False) -> DataFrame:
    """``df`` with ``column``, a number below ``n``, replaced by its place in the permutation of [0, n) (or back)."""
    a, b = sides(n)
    df = permuted(df, column, n, seed, inverse)
    if a * b == max(n, 1):
        return df
    ends = df.sparkSession.range(n, a * b).select(F.col("id").alias("__cs_out"), F.col("id").alias("__cs_in"))
    while True:
        stay = ends.where(F.col("__cs_in") < n)
        ends = written(stay.unionByName(permuted(ends.where(F.col("__cs_in") >= n), "__cs_in", n, seed, inverse)), "walks")
        if ends.where(F.col("__cs_in") >= n).isEmpty():
            break
    end = F.broadcast(ends)  # fewer than ceil(sqrt(n)) rows
    return df.join(end, df[column] == end["__cs_out"], "left").withColumn(column, F.coalesce("__cs_in", column)).drop("__cs_out", "__cs_in")


def sharded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, seed: int = SEED, columns: list[str] | None = None) -> DataFrame:
    """``columns`` of every row of ``docs`` (only the id, if not given) with ``__cs_size``, ``__cs_crc``, ``__cs_shard``
    and ``__cs_slot``.

    The order that the numbers follow is id (nulls first), size, CRC-32 and hash of the text.  A null text is empty but
    its size is that of a row without text, which is the same.  Repeated rows are rows of their own; which of them
    gets which slot makes no difference.  An empty table gives an empty result; a table of fewer rows than shards
    leaves shards empty.
    """
    text = text_or_empty(text_col)
    columns = [id_col] if columns is None else columns
    keys = {"__cs_key": F.col(id_col), "__cs_size": (F.octet_length(text) + ROW_BYTES).cast("long"), "__cs_crc": F.crc32(text.cast("binary")), "__cs_hash": F.xxhash64(text)}
    rows = numbered(docs.select(*columns, *[c.alias(k) for k, c in keys.items()]), list(keys), "sharding")
    placed = walked(rows, "__cs_row", rows.count(), seed)
    shard, slot = (F.col("__cs_row") % shards).cast("int"), F.expr(f"__cs_row div {shards}")
    return placed.withColumns({"__cs_shard": shard, "__cs_slot": slot}).drop("__cs_key", "__cs_hash", "__cs_row")


def row_numbers(places: DataFrame, n: int, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """``places`` (``__cs_shard``, ``__cs_slot``) of a shuffle of ``n`` rows with ``__cs_row``, the numbers of the rows there."""
    return walked(places.withColumn("__cs_row", F.col("__cs_slot") * shards + F.col("__cs_shard")), "__cs_row", n, seed, inverse=True)


def write_shards(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, seed: int = SEED) -> None:
    """Whole rows as Parquet in folders ``__cs_shard=0``, ..., each shard's files in the order of its slots.

    A shard is written by as many tasks as its part of the data needs.
    """
    rows = written(sharded(docs, id_col, text_col, shards, seed, docs.columns).drop("__cs_size", "__cs_crc"), "shards")
    rows.repartitionByRange("__cs_shard", "__cs_slot").sortWithinPartitions("__cs_shard", "__cs_slot").write.partitionBy("__cs_shard").parquet(path)


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    out = sharded(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id",
        F.col("__cs_size").alias("size"),
        F.col("__cs_crc").alias("text_crc32"),
        F.lit("rows").alias("law"),
        F.col("__cs_shard").alias("shard"),
        F.col("__cs_slot").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


#: CRC-32 byte by byte with the usual table, row numbers by a window, and the network as a recursion of one round a
#: step that goes on until a whole number of passes ends below n.
OP12_SQL = f"""
WITH RECURSIVE crc_table AS (
  SELECT list_transform(range(256), lambda x: list_reduce(list_prepend(x, range(8)), lambda c, y: xor(c >> 1, 3988292384 * (c & 1)))) AS t
), docs AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + {ROW_BYTES} AS size, hex(encode(coalesce(text, ''))) AS h FROM documents
), crcs AS (
  SELECT doc_id, size, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(h, '..'), lambda x: ('0x' || x)::BIGINT)),
    lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1]))) AS crc
  FROM docs, crc_table
), numbers AS (
  SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, size, crc) - 1 AS rn FROM crcs
), total AS (
  SELECT n, a, (n + a - 1) // a AS b FROM (SELECT count(*) AS n, ceil(sqrt(count(*)))::BIGINT AS a FROM crcs)
), walk(rn, l, r, i) AS (
  SELECT rn, rn // b, rn % b, 0 FROM numbers, total
  UNION ALL
  SELECT rn,
    CASE WHEN i % 2 = 0 THEN (l + ('0x' || substr(md5('{SEED}:' || (i % {ROUNDS}) || ':' || r), 1, 15))::BIGINT) % a ELSE l END,
    CASE WHEN i % 2 = 1 THEN (r + ('0x' || substr(md5('{SEED}:' || (i % {ROUNDS}) || ':' || l), 1, 15))::BIGINT) % b ELSE r END,
    i + 1
  FROM walk, total WHERE NOT (i > 0 AND i % {ROUNDS} = 0 AND l * b + r < n)
)
SELECT doc_id, size::BIGINT AS size, crc::BIGINT AS text_crc32, 'rows' AS law, ((l * b + r) % {SHARDS})::INTEGER AS shard,
  ((l * b + r) // {SHARDS})::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM walk, total, numbers WHERE walk.rn = numbers.rn AND i > 0 AND i % {ROUNDS} = 0 AND l * b + r < n
"""
