"""Operator 9: substring dedup by sliding sentence spans.

Every run of consecutive sentences that is just long enough is hashed, at each sentence both forward (the shortest
run that begins there) and backward (the shortest run that ends there).  A run is long enough if it has at least
``min_sentences`` sentences and ``min_words`` words, or is one sentence of ``long_sentence`` words.  As a run's
bounds depend on nothing outside it, a passage that recurs anywhere, in any text, yields the same runs, and its
forward and backward runs together cover all its sentences.

All runs are joined on their hash over the whole table.  The first occurrence (least id, text hash, position)
stays; sentences covered by any other occurrence go.

Scale: 24 bytes a run are shuffled twice, the texts once.  A run that a third of the documents hold is counted by
a partial aggregation in each task, and the join that marks it is one that AQE splits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimscope.llm.common import KEY, TEXT_HASH, batch_of, column_chunks, identity, keyed_texts, lean, taken, text_or_empty, written
from claimscope.llm.words import _powers, mix64, sentences_of, words_of

MIN_SENTENCES, MIN_WORDS, LONG_SENTENCE = 2, 24, 50


def spans_of(texts: list[str], min_sentences: int, min_words: int, long_sentence: int):
    """(text index, start, end, hash) of every run, positions in code points of the text."""
    w = words_of(texts)
    s = sentences_of(w)
    n = len(s.start)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z, np.zeros(0, np.uint64)
    words = np.zeros(n + 1, np.int64)
    np.cumsum(s.words, out=words[1:])
    at = np.arange(n)
    bounds = np.searchsorted(s.doc, np.arange(len(texts) + 1))
    lo, hi = bounds[s.doc], bounds[s.doc + 1]
    fwd = np.maximum(np.searchsorted(words, words[:-1] + min_words), at + min_sentences)  # one past the last
    fwd = np.where(s.words >= long_sentence, at + 1, fwd)
    back = np.minimum(np.searchsorted(words, words[1:] - min_words, side="right") - 1, at + 1 - min_sentences)
    back = np.where(s.words >= long_sentence, at, back)
    ok_f, ok_b = fwd <= hi, back >= lo
    first = np.concatenate([at[ok_f], back[ok_b]])
    past = np.concatenate([fwd[ok_f], at[ok_b] + 1])
    key = np.unique(first * np.int64(n + 1) + past)
    first, past = key // (n + 1), key % (n + 1)
    up, down = _powers(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(mix64(s.hash + np.uint64(3)) * up, out=total[1:])
    h = mix64((total[past] - total[first]) * down[first] + (past - first).astype(np.uint64))
    base = w.doc_start[s.doc[first]]
    return s.doc[first], s.start[first] - base, s.end[past - 1] - base, h


def sentence_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS, long_sentence: int = LONG_SENTENCE) -> DataFrame:
    """``__cs_id``, ``__cs_key``, ``__cs_th``, ``start``, ``end`` and ``span`` (hash) of every run of every text."""
    if not 1 <= min_sentences or min_words < 1 or long_sentence < min_words:
        raise ValueError("need min_sentences >= 1 and 1 <= min_words <= long_sentence")
    keyed = keyed_texts(docs, id_col, text_col)
    out = T.StructType([keyed.schema[c] for c in ("__cs_id", KEY, TEXT_HASH)] + [T.StructField(c, T.LongType()) for c in ("start", "end", "span")])

    def spans(batches):
        for b in batches:
            schema = pa.schema([("__cs_id", b.schema.field("__cs_id").type), (KEY, pa.int64()), (TEXT_HASH, pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("span", pa.int64())])
            for i, _, texts in column_chunks(b.column("__cs_text")):
                d, start, end, h = spans_of(texts, min_sentences, min_words, long_sentence)
                yield batch_of(schema, __cs_id=taken(b.column("__cs_id"), d + i), __cs_key=taken(b.column(KEY), d + i), __cs_th=taken(b.column(TEXT_HASH), d + i), start=start, end=end, span=h.view(np.int64))

    return keyed.mapInArrow(lean(spans), out)


def merged(ranges) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def repeated_ranges(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **sizes) -> DataFrame:
    """``__cs_key``, ``__cs_th`` and ``__cs_cut`` (start and end of each non-first run) of documents that have any."""
    spans = written(sentence_spans(docs, id_col, text_col, **sizes), "spans")
    place = F.struct("__cs_id", TEXT_HASH, KEY, "start")
    seen = spans.groupBy("span").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
    seen = written(seen.where("n > 1").drop("n"), "repeated")
    again = spans.join(seen, "span").where(~place.eqNullSafe(F.col("first")))
    return again.groupBy(KEY, TEXT_HASH).agg(F.collect_set(F.struct("start", "end")).alias("__cs_cut"))


def remove_repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **sizes) -> DataFrame:
    """``docs`` with the sentences of repeated runs cut out of the text, and ``cuts``: the ranges removed.

    All input columns are kept (an input column ``cuts`` is replaced); a document never disappears, at worst its
    text becomes empty.  Null texts become empty.  Rows equal in id and text are one document: they lose the same
    sentences.  The result is the same in any row order.
    """
    cut_type = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    docs = docs.drop("cuts").withColumn(text_col, text_or_empty(text_col))
    cuts = repeated_ranges(docs, id_col, text_col, **sizes)
    left = docs.withColumns(dict(zip((KEY, TEXT_HASH), identity(id_col, text_col), strict=True)))
    both = left.join(cuts, [KEY, TEXT_HASH], "left")
    both = both.select(*docs.columns, "__cs_cut")
    out = T.StructType([*docs.schema.fields, T.StructField("cuts", cut_type)])

    def cut(batches):
        for whole in batches:
            for i, j, texts in column_chunks(whole.column(text_col), 1 << 21):
                b = whole.slice(i, j - i)
                gone = [merged((x["start"], x["end"]) for x in r) if r else [] for r in b.column("__cs_cut").to_pylist()]
                for k, ranges in enumerate(gone):
                    if ranges:
                        edges = [0, *[x for r in ranges for x in r], len(texts[k])]
                        texts[k] = "".join(texts[k][a:e] for a, e in zip(edges[::2], edges[1::2], strict=True))
                cols = {n: b.column(n) for n in b.schema.names if n != "__cs_cut"}
                cols[text_col] = pa.array(texts, b.schema.field(text_col).type)
                pairs = pa.array([[{"start": a, "end": e} for a, e in g] for g in gone], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
                yield pa.RecordBatch.from_arrays([*cols.values(), pairs], names=[*cols, "cuts"])

    return both.mapInArrow(lean(cut), out)


def op9_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document with its text less repeated spans: doc_id, text, n_chars, n_removed (characters), cuts."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = remove_repeated_spans(docs)
    removed = F.aggregate("cuts", F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["start"])
    return out.select("doc_id", "text", F.char_length("text").cast("long").alias("n_chars"), removed.alias("n_removed"), "cuts")
