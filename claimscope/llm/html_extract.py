"""Operator 1: main text of HTML pages by message passing over the DOM tree.

The model (see ``html_model``) is trained from ``MADE_PAGES`` generated labelled pages of many layouts and at most
about ``SAMPLE_PAGES`` pages of the table that label themselves by their markup; both bounds are parameters, and the
trained model is a few hundred numbers.  Every page is then read whole, in batches, without a shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimscope.llm.common import column_chunks, text_or_empty
from claimscope.llm.dom import parse
from claimscope.llm.html_model import TreeModel, fit, forest, marginals, training_pages

MADE_PAGES, SAMPLE_PAGES, CUTOFF = 300, 100, 0.5


def train(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", made: int = MADE_PAGES, sample: int = SAMPLE_PAGES) -> TreeModel:
    """Fit the tree model.  The sample is drawn and ordered by a hash of the id, so that the order of the rows does not
    matter; pages with a null id are not drawn."""
    n = pages.count()
    rank = F.xxhash64(F.col(id_col), F.lit("html sample"))
    draw = F.pmod(rank, F.lit(max(1, -(-n // max(1, sample))))) == 0
    drawn = pages.where(F.col(id_col).isNotNull() & draw).select(text_or_empty(html_col).alias("h"), rank.alias("r"))
    rows = drawn.orderBy("r", "h").limit(2 * sample).collect() if sample else []
    return fit(training_pages([r["h"] for r in rows], made))


def main_texts(htmls: list[str], model: TreeModel, cutoff: float = CUTOFF) -> list[str]:
    """Main text of each page: its content leaves in page order, one a line."""
    pages = [parse(h) for h in htmls]
    x = forest(pages)
    p = marginals(x, model)
    out = []
    for page, a in zip(pages, x.first, strict=False):
        out.append("\n".join(t for k, t in enumerate(page.text) if t and p[a + k] >= cutoff))
    return out


def extract(pages: DataFrame, model: TreeModel, html_col: str = "html", cutoff: float = CUTOFF) -> DataFrame:
    """``pages`` with ``text`` and ``n_chars`` instead of the HTML (columns of these names are replaced).

    A null, empty or broken page and one without content get the empty text.  Rows are independent of each other.
    """
    src = pages.select(*[F.col(c) for c in pages.columns if c not in (html_col, "text", "n_chars")], text_or_empty(html_col).alias("__cs_html"))
    shared = pages.sparkSession.sparkContext.broadcast((model.weights, model.pair))
    out = T.StructType([f for f in src.schema if f.name != "__cs_html"] + [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches):
        own = TreeModel(*shared.value)
        for b in batches:
            texts: list[str] = []
            for _, _, htmls in column_chunks(b.column("__cs_html"), 1 << 20, 256):
                texts += main_texts(htmls, own, cutoff)
            kept = [c for c in b.schema.names if c != "__cs_html"]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], pa.array(texts, pa.string()), pa.array(np.array([len(t) for t in texts], np.int64))], names=[*kept, "text", "n_chars"])

    return src.mapInArrow(run, out)


def op1_html_text(spark, sf_dir: str) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extract(pages, train(pages)).select("page_id", "url", "text", "n_chars")
