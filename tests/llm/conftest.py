import pytest

from claimscope.llm.common import shared_dir


@pytest.fixture(scope="session")
def docs_of(spark):
    """DataFrame of (doc_id, text) rows, with columns whose names are also used inside operators."""

    def make(rows, partitions=3):
        schema = "doc_id bigint, text string, span string, n bigint, score double, root string"
        return spark.createDataFrame([(i, t, "x", 1, 0.5, None) for i, t in rows], schema).repartition(partitions)

    shared_dir(spark)
    return make
