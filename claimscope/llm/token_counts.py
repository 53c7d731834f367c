"""Operator 3: token counts of sections from one encoding of the whole document.

A document is encoded once as a whole, so tokens are those that training sees.  Each token's span in bytes follows
from the lengths of the tokens before it.  The sections of a document, given as character ranges or else its lines
(with the line feed that ends them), are joined to the token spans as intervals: by binary search of the sections'
bounds among the tokens' bounds.  A token that crosses a bound goes by ``rule``:

* ``start``: to the section that holds its first byte;
* ``end``: to the section that holds its last byte;
* ``share``: to each section by its share of the token's bytes (fractions).

With sections that cover a document without overlap, all three add up to the document's token count.

Scale: no shuffle; a task holds one batch of documents, and a document's token spans are one array.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimscope.llm.common import taken, text_or_empty

RULES = ("start", "end", "share")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=2)
def encoder(path: str):
    """The encoding and each token's number of bytes."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    size = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, i in ranks.items():
        size[i] = len(token)
    return tiktoken.Encoding("sections", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), size


def token_edges(text: str, path: str) -> np.ndarray:
    """Byte positions where the tokens of a text begin, and its end."""
    enc, size = encoder(path)
    ids = enc.encode_to_numpy(text, disallowed_special=()) if text else np.zeros(0, np.int64)
    edges = np.zeros(len(ids) + 1, np.int64)
    np.cumsum(size[ids], out=edges[1:])
    return edges


def count_in(edges: np.ndarray, start: np.ndarray, end: np.ndarray, rule: str) -> np.ndarray:
    """Tokens that each byte range [start, end) is given; a range without bytes is given none."""
    if rule == "share":
        n = np.arange(len(edges), dtype=float)
        out = np.interp(end, edges, n) - np.interp(start, edges, n)
    else:
        place = edges[:-1] if rule == "start" else edges[1:] - 1
        out = (np.searchsorted(place, end) - np.searchsorted(place, start)).astype(float)
    return np.where(end > start, out, 0.0)


def line_bounds(text: str) -> list[int]:
    """Character positions where lines begin, and the text's end; an empty text has one empty line."""
    out = [0]
    at = text.find("\n")
    while at >= 0 and at + 1 < len(text):
        out.append(at + 1)
        at = text.find("\n", at + 1)
    return [*out, len(text)]


def section_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sections_col: str | None = None, rule: str = "start", path: str | None = None) -> DataFrame:
    """``id_col``, ``section`` (from 0), ``start``, ``n_chars``, ``n_tokens``, ``doc_tokens`` of every section.

    ``sections_col``, if given, has an array of structs of start and end in characters, in any order, overlapping or
    with gaps; bounds outside the text are moved to its ends.  A null or empty text has, without that column, one
    empty section.  Repeated rows give repeated results.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    path = path or tokenizer_path()
    cols = [F.col(id_col).alias("__cs_id"), text_or_empty(text_col).alias("__cs_text")]
    src = docs.select(*cols, *([F.col(sections_col).alias("__cs_sections")] if sections_col else []))
    names = ["section", "start", "n_chars", "n_tokens", "doc_tokens"]
    types = [T.LongType(), T.LongType(), T.LongType(), T.DoubleType() if rule == "share" else T.LongType(), T.LongType()]
    out = T.StructType([T.StructField(id_col, src.schema["__cs_id"].dataType), *[T.StructField(n, t) for n, t in zip(names, types, strict=True)]])

    def count(batches):
        for b in batches:
            texts = b.column("__cs_text").to_pylist()
            given = b.column("__cs_sections").to_pylist() if sections_col else [None] * len(texts)
            row, parts = [], [[] for _ in names]
            for r, (text, own) in enumerate(zip(texts, given, strict=True)):
                if sections_col:
                    bounds = np.array([(x["start"], x["end"]) for x in own or []], np.int64).reshape(-1, 2).clip(0, len(text))
                    start, end = bounds[:, 0], bounds[:, 1]
                else:
                    lines = np.array(line_bounds(text), np.int64)
                    start, end = lines[:-1], lines[1:]
                data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
                at = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))  # byte position of each character
                edges = token_edges(text, path)
                n = count_in(edges, at[start], at[np.maximum(end, start)], rule)
                row.append(np.full(len(start), r))
                for got, x in zip(parts, (np.arange(len(start)), start, np.maximum(end - start, 0), n, np.full(len(start), len(edges) - 1)), strict=True):
                    got.append(x)
            if row:
                columns = [np.concatenate(x) for x in parts]
                yield pa.RecordBatch.from_arrays([taken(b.column("__cs_id"), np.concatenate(row)), *[pa.array(c, pa.float64() if isinstance(t, T.DoubleType) else pa.int64(), safe=False) for c, t in zip(columns, types, strict=True)]], names=[id_col, *names])

    return src.mapInArrow(count, out)


def op3_token_counts(spark, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document: doc_id, section, start, n_chars, n_tokens, doc_tokens."""
    return section_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
