"""Cleans the table ``documents`` for training and packs it: five stages, each written as Parquet and read again.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept.  All but the last return the
columns of the input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimscope.llm.common import read_table, written
from claimscope.llm.decontaminate import drop_contaminated
from claimscope.llm.language_id import keep_known_language
from claimscope.llm.near_dedup import keep_one
from claimscope.llm.packing import pack
from claimscope.llm.substring_dedup import remove_repeated_spans


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; texts without a letter, or of no language with enough probability, go."""
    return keep_known_language(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the least doc_id."""
    return keep_one(docs)


def repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, less the sentences of repeated spans; ``n_chars`` follows the new text.

    A document whose whole text repeats earlier spans stays with an empty text.
    """
    cut = remove_repeated_spans(docs)
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return cut.select(*docs.columns)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no item of ``benchmark`` was found."""
    return drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 4096 tokens, with their ids.

    By now an executor has workers of all stages before, so only those at work remember pieces, and fewer of them.
    """
    return pack(docs, known_words=100_000, lasting=False)


STAGES = [
    ("language_id", language),
    ("near_dedup", near_duplicates),
    ("substring_dedup", repeated_spans),
    ("decontamination", benchmark_leaks),
    ("packing", packed),
]

#: SQL can't express the trained model, the signatures or the encoding; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return written(STAGES[-1][1](spark, docs, sf_dir), STAGES[-1][0])


QUERIES = {"pipeline": run}
