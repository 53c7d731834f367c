"""Session helpers: a local session for tests/bench and the checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "claimscope") -> SparkSession:
    """Session for tests and the bench.  On a cluster use the cluster's own session."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("CLAIMSCOPE_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Folder for reliable checkpoints, as the cluster names it in ``spark.checkpoint.dir``.

    Only operators that checkpoint call this.  Where the setting is absent, a
    local session gets a folder on this machine; on a cluster that would not
    be shared, so it is an error there.  No session setting is changed.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"file://{tempfile.gettempdir()}/claimscope-checkpoints"
    sc.setCheckpointDir(folder)
    return sc.getCheckpointDir() or folder


#: Java runs a method beyond this size without compiling it to machine code.
METHOD_LIMIT = 8000
_METHOD_LIMIT_KEY = "spark.sql.codegen.hugeMethodLimit"


@contextmanager
def short_methods(spark: SparkSession) -> Iterator[None]:
    """For the jobs run inside: expressions over very many columns are generated
    as several methods of a size that Java compiles, instead of a single one.
    The session's own setting is put back, and a smaller one is left alone."""
    own = spark.conf.get(_METHOD_LIMIT_KEY, None)
    if own is not None and int(own) <= METHOD_LIMIT:
        yield
        return
    spark.conf.set(_METHOD_LIMIT_KEY, str(METHOD_LIMIT))
    try:
        yield
    finally:
        if own is None:
            spark.conf.unset(_METHOD_LIMIT_KEY)
        else:
            spark.conf.set(_METHOD_LIMIT_KEY, own)


#: What a task of ``small_tasks`` reads of a shuffle, packed.
TASK_BYTES = "8m"


@contextmanager
def small_tasks(spark: SparkSession) -> Iterator[None]:
    """For the jobs run inside: neighbouring shuffle partitions are put together
    up to ``TASK_BYTES`` only, so that a task's hash map or sort stays small.
    The session's own setting is put back."""
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    own = spark.conf.get(key, None)
    spark.conf.set(key, TASK_BYTES)
    try:
        yield
    finally:
        if own is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, own)


def saved(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back: the work
    before it is done once, as with a checkpoint, but the columns are packed
    and later readers take only those that they use."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"
    with short_methods(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
