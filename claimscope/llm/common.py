"""Shared folder, written tables, and row batches for the Arrow functions."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KEY, TEXT_HASH = "__cs_key", "__cs_th"


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and every executor see, as the cluster names it in ``spark.checkpoint.dir``.

    Only in a local session without the setting is a folder on this machine used; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.gettempdir()}/claimscope-checkpoints"
    return base.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/claimscope-llm/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    """``df`` with ``__cs_row``, its rows' numbers from 0 in the order of ``keys`` (nulls first), over the whole table.

    One range shuffle and a table of one row a partition, whose running sum gives each partition its first number.
    Rows equal in ``keys`` are told apart by their place in a written table, so that a row repeated very often is
    dealt over many partitions.  Only DataFrame functions.
    """
    src = written(df, label).withColumn("__cs_tie", F.monotonically_increasing_id())
    order = [*keys, "__cs_tie"]
    put = src.repartitionByRange(*order).sortWithinPartitions(*order).drop("__cs_tie")
    put = written(put.withColumn("__cs_at", F.monotonically_increasing_id()), label)
    part = F.shiftright("__cs_at", 33)
    sizes = put.groupBy(part.alias("__cs_part")).agg(F.count(F.lit(1)).alias("__cs_n"))
    before = Window.orderBy("__cs_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    first = sizes.select("__cs_part", F.coalesce(F.sum("__cs_n").over(before), F.lit(0)).alias("__cs_first"))
    place = F.col("__cs_first") + F.col("__cs_at").bitwiseAND(F.lit((1 << 33) - 1))
    return put.withColumn("__cs_part", part).join(F.broadcast(first), "__cs_part").withColumn("__cs_row", place).drop("__cs_part", "__cs_first", "__cs_at")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def keyed_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``__cs_id``, ``__cs_key``, ``__cs_th`` and ``__cs_text``.

    A document's identity is the pair of its key (hash of id and text) and the hash of its text, never null.
    """
    text = text_or_empty(text_col)
    return docs.select(F.col(id_col).alias("__cs_id"), *identity(id_col, text_col), text.alias("__cs_text"))


def identity(id_col: str, text_col: str) -> list[Column]:
    text = text_or_empty(text_col)
    return [F.xxhash64(F.col(id_col), F.lit(0), text).alias(KEY), F.xxhash64(text).alias(TEXT_HASH)]


def _cuts(sizes: list[int], max_size: int, max_rows: int) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, n in enumerate(sizes):
        if i > start and (size + n > max_size or i - start >= max_rows):
            yield start, i
            start, size = i, 0
        size += n
    if start < len(sizes):
        yield start, len(sizes)


def column_chunks(column: pa.Array, max_bytes: int = 1 << 19, max_rows: int = 4096) -> Iterator[tuple[int, int, list[str]]]:
    """(from, to, texts) of row ranges of at most ``max_rows`` rows and about ``max_bytes``; a null text is empty.

    Only one chunk is held as Python strings.  A text longer than the limit forms a chunk of its own, so nothing is
    cut.
    """
    sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    for i, j in _cuts(sizes, max_bytes, max_rows):
        yield i, j, [t or "" for t in column.slice(i, j - i).to_pylist()]


def column_slices(column: pa.Array, max_bytes: int, max_rows: int = 1 << 16) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from, to, bytes, edges) of row ranges: UTF-8 bytes of the texts in one array, without Python strings.

    Text ``k`` of a range is ``bytes[edges[k]:edges[k + 1]]``.  The column has no nulls.  A text longer than the limit
    forms a range of its own.
    """
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    n = len(column)
    edges = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if n and column.buffers()[2] and column.buffers()[2].size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = min(max(i + 1, int(np.searchsorted(edges, edges[i] + max_bytes, side="right")) - 1), n, i + max_rows)
        yield i, j, data[edges[i] : edges[j]], edges[i : j + 1] - edges[i]
        i = j


#: Functions that empty what an operator remembers in a worker between tasks.
CACHES: list[Callable[[], None]] = []


def lean(task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """A task for ``mapInArrow`` that starts without what other operators' tasks left in a reused worker, and ends by
    handing freed memory back to the system."""

    def run(batches):
        from claimscope.llm import common  # the worker's own module, with its caches

        for empty in common.CACHES:
            empty()
        yield from task(batches)
        for empty in common.CACHES:  # Spark deals tasks to idle workers in turn, and each would keep its own
            empty()
        common.hand_back()

    return run


def hand_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def batch_of(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if not isinstance(columns[f.name], (pa.Array, pa.ChunkedArray)) else columns[f.name] for f in schema], schema=schema)


def taken(column: pa.Array, rows) -> pa.Array:
    return column.take(pa.array(rows, pa.int64()))
