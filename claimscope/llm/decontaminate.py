"""Operator 8: benchmark decontamination by n-gram seeds and Smith-Waterman alignment.

1. Every run of three words of a test item is a seed; of a shorter item, the run of all its words is.  A bitmap of their hashes, of fixed size, is broadcast; one pass
   over the documents keeps the runs that it lets through, a small part of all.
2. Seeds join documents to items, every run that a document holds; around each hit lies the window of words that the
   item could take up.  Windows of one item that overlap are merged, and only these windows travel on, not the documents.
3. Smith-Waterman aligns item and window, word by word: match 1, mismatch and gap -1.  The item is found if the
   score reaches ``needed_score``; edits, insertions and omissions only lower it.  Windows that hold fewer words of the
   item than that are not aligned.

No seed, candidate or item is capped; only a copy that holds no three words of the item in a row has no seed.  A passage
that a third of the documents hold yields rows in proportion to those documents; the joins are on (run) and (item),
which AQE splits where one key is hot.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimscope.llm.common import KEY, TEXT_HASH, batch_of, column_chunks, identity, keyed_texts, lean, taken, text_or_empty, written
from claimscope.llm.words import first_word, word_grams, words_of

GRAM, BITMAP_BITS = 3, 24
SHARE, LEAST_WORDS, ENOUGH_WORDS = 0.5, 8, 20


def needed_score(words: Column, share: float = SHARE, least: int = LEAST_WORDS, enough: int = ENOUGH_WORDS) -> Column:
    """``share`` of the item's words but at least ``least`` (or all of a shorter item), and never over ``enough``."""
    return F.least(F.lit(float(enough)), F.greatest(words * F.lit(float(share)), F.least(words.cast("double"), F.lit(float(least)))))


def item_words(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``item`` (number), ``item_id``, ``words`` (hashes), ``grams`` (hashes of the runs of three words, or of
    all words of a shorter item) of distinct items.  Items without a word have no run and are never found."""
    src = items.select(F.col(id_col).alias("item_id"), text_or_empty(text_col).alias("text")).distinct()
    src = src.select(F.xxhash64(F.col("item_id"), F.lit(0), F.col("text")).alias("item"), "item_id", "text")
    out = T.StructType([src.schema["item"], src.schema["item_id"], T.StructField("words", T.ArrayType(T.LongType())), T.StructField("grams", T.ArrayType(T.LongType()))])

    def split(batches):
        for b in batches:
            words, grams = [], []
            for t in b.column("text").to_pylist():
                w = words_of([t])
                words.append(w.hash.view(np.int64))
                grams.append(word_grams(w, max(1, min(GRAM, len(w.hash))))[0].view(np.int64))
            lists = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("item"), b.column("item_id"), pa.array(words, lists), pa.array(grams, lists)], names=["item", "item_id", "words", "grams"])

    return src.mapInArrow(split, out)


def bitmap(grams: DataFrame, bits: int = BITMAP_BITS) -> np.ndarray:
    """Bitmap of 2^bits bits of the hashes in column ``gram``; the driver receives at most 2^bits / 64 rows."""
    low = F.col("gram").bitwiseAND(F.lit((1 << bits) - 1))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), low.bitwiseAND(F.lit(63)).cast("int"))
    rows = grams.groupBy(F.shiftright(low, 6).alias("at")).agg(F.bit_or(bit).alias("v")).toPandas()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[rows["at"].to_numpy(np.int64)] = rows["v"].to_numpy(np.int64).view(np.uint64)
    return out


def gram_hits(docs: DataFrame, grams: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``__cs_key``, ``__cs_th``, ``gram``, ``at`` (number of the first word) of runs that the bitmap lets through.

    ``grams`` has ``gram`` and ``len`` (words of its item), which tells the lengths of the runs.
    """
    keyed = keyed_texts(docs, id_col, text_col).drop("__cs_id")
    mask = np.uint64((1 << BITMAP_BITS) - 1)
    sizes = sorted(r["n"] for r in grams.select(F.least("len", F.lit(GRAM)).alias("n")).distinct().collect())  # at most GRAM
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(grams))
    schema = pa.schema([(KEY, pa.int64()), (TEXT_HASH, pa.int64()), ("gram", pa.int64()), ("at", pa.int64())])

    def hits(batches):
        known = shared.value
        for b in batches:
            for i, _, texts in column_chunks(b.column("__cs_text")):
                w = words_of(texts)
                for n in sizes:
                    g, d, at = word_grams(w, n)
                    low = g & mask
                    ok = np.flatnonzero((known[(low >> np.uint64(6)).astype(np.int64)] >> (low & np.uint64(63))) & np.uint64(1))
                    if not len(ok):
                        continue
                    yield batch_of(schema, __cs_key=taken(b.column(KEY), d[ok] + i), __cs_th=taken(b.column(TEXT_HASH), d[ok] + i), gram=g[ok].view(np.int64), at=at[ok] - first_word(w)[d[ok]])

    return keyed.mapInArrow(lean(hits), "__cs_key bigint, __cs_th bigint, gram bigint, at bigint")


def align(items: list[np.ndarray], windows: list[np.ndarray]) -> np.ndarray:
    """Smith-Waterman score of each pair: match 1, mismatch -1, gap -1.

    Pairs are padded to one shape and run side by side; within a row of the table, a gap's best start is a running
    maximum.
    """
    best = np.zeros(len(items), np.int32)
    order = sorted(range(len(items)), key=lambda k: (len(windows[k]), len(items[k])))
    at = 0
    while at < len(order):
        part = order[at : at + max(1, min(512, (1 << 20) // max(1, len(windows[order[min(at + 511, len(order) - 1)]]))))]
        at += len(part)
        width, height = max(len(windows[k]) for k in part), max(len(items[k]) for k in part)
        b = np.zeros((len(part), width), np.int64)
        b_ok = np.zeros((len(part), width), bool)
        a = np.zeros((len(part), height), np.int64)
        a_ok = np.zeros((len(part), height), bool)
        for r, k in enumerate(part):
            b[r, : len(windows[k])], b_ok[r, : len(windows[k])] = windows[k], True
            a[r, : len(items[k])], a_ok[r, : len(items[k])] = items[k], True
        step = np.arange(width, dtype=np.int32)
        h = np.zeros((len(part), width + 1), np.int32)
        top = np.zeros(len(part), np.int32)
        for i in range(height):
            same = (b == a[:, i : i + 1]) & b_ok & a_ok[:, i : i + 1]
            t = np.maximum(np.maximum(h[:, :-1] + np.where(same, 1, -1), h[:, 1:] - 1), 0).astype(np.int32)
            h[:, 1:] = np.maximum.accumulate(t + step, axis=1) - step
            top = np.maximum(top, h.max(axis=1))
        best[part] = top
    return best


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", share: float = SHARE, least: int = LEAST_WORDS, enough: int = ENOUGH_WORDS) -> DataFrame:
    """One row for each document and item found in it: ``__cs_key``, ``__cs_th``, ``__cs_id``, ``item_id``, ``score``,
    ``item_words``, ``word_from`` and ``word_to`` (the best window, in words of the document).

    Null and empty texts and items match nothing; equal items with different ids are each found; rows that repeat
    id and text are one document.  Empty tables give an empty result.
    """
    item = written(item_words(items, item_id_col, item_text_col), "items")
    grams = item.select("item", F.size("words").alias("len"), F.posexplode("grams").alias("pos", "gram"))
    hits = written(gram_hits(docs, grams.select("gram", "len"), id_col, text_col), "hits")
    found = hits.join(grams, "gram")
    slack = F.expr("4 + len div 4")
    spans = found.select(KEY, TEXT_HASH, "item", (F.col("at") - F.col("pos") - slack).alias("lo"), (F.col("at") - F.col("pos") + F.col("len") + slack).alias("hi"))
    wanted = spans.distinct().groupBy(KEY, TEXT_HASH).agg(F.collect_list(F.struct("item", "lo", "hi")).alias("spans"))
    keyed = keyed_texts(docs, id_col, text_col).join(wanted, [KEY, TEXT_HASH])
    cut_type = T.StructType([keyed.schema[c] for c in (KEY, TEXT_HASH, "__cs_id")] + [T.StructField(c, T.LongType()) for c in ("item", "word_from", "word_to")] + [T.StructField("part", T.ArrayType(T.LongType()))])

    def windows(batches):
        for b in batches:
            texts, spans = b.column("__cs_text").to_pylist(), b.column("spans").to_pylist()
            row, num, lo, hi, parts = [], [], [], [], []
            for r, (t, s) in enumerate(zip(texts, spans, strict=True)):
                words = words_of([t]).hash.view(np.int64)
                last = None
                for x in sorted(s, key=lambda x: (x["item"], x["lo"])):
                    a, z = max(x["lo"], 0), min(x["hi"], len(words))
                    if last == x["item"] and a <= hi[-1]:
                        hi[-1] = max(hi[-1], z)
                    else:
                        row.append(r), num.append(x["item"]), lo.append(a), hi.append(z)
                        last = x["item"]
                parts += [words[a:z] for a, z in zip(lo[len(parts) :], hi[len(parts) :], strict=True)]
            kept = [taken(b.column(c), row) for c in (KEY, TEXT_HASH, "__cs_id")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(num, pa.int64()), pa.array(lo, pa.int64()), pa.array(hi, pa.int64()), pa.array(parts, pa.list_(pa.int64()))], names=[f.name for f in cut_type])

    cut = keyed.mapInArrow(lean(windows), cut_type)
    both = cut.join(item.select("item", "item_id", "words", needed_score(F.size("words"), share, least, enough).alias("needed")), "item")
    scored_type = T.StructType([both.schema[c] for c in (KEY, TEXT_HASH, "__cs_id", "item", "item_id", "word_from", "word_to")] + [T.StructField("item_words", T.IntegerType()), T.StructField("score", T.IntegerType())])

    def score(batches):
        for b in batches:
            a, w = ([x.values.to_numpy(zero_copy_only=False) for x in b.column(c)] for c in ("words", "part"))
            kept = [b.column(c) for c in (KEY, TEXT_HASH, "__cs_id", "item", "item_id", "word_from", "word_to")]
            needed = b.column("needed").to_pylist()
            able = [k for k, n in enumerate(needed) if np.isin(a[k], w[k]).sum() >= n]  # each word of the item matches once
            best = np.zeros(len(a), np.int32)
            best[able] = align([a[k] for k in able], [w[k] for k in able])
            ok = np.flatnonzero(best >= np.array(needed))
            yield pa.RecordBatch.from_arrays([*[taken(x, ok) for x in kept], pa.array([len(a[k]) for k in ok], pa.int32()), pa.array(best[ok], pa.int32())], names=[f.name for f in scored_type])

    scored = both.mapInArrow(lean(score), scored_type)
    best = scored.groupBy(KEY, TEXT_HASH, "item").agg(F.max(F.struct("score", (-F.col("word_from")).alias("before"), "word_to", "__cs_id", "item_id", "item_words")).alias("m"))
    return best.select(KEY, TEXT_HASH, "m.__cs_id", "m.item_id", "m.score", "m.item_words", (-F.col("m.before")).alias("word_from"), "m.word_to")


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` in which no item was found, all columns as they were."""
    bad = written(contaminated(docs, items, id_col, text_col, **how).select(KEY, TEXT_HASH).distinct(), "contaminated")
    return docs.withColumns(dict(zip((KEY, TEXT_HASH), identity(id_col, text_col), strict=True))).join(bad, [KEY, TEXT_HASH], "left_anti").select(*docs.columns)


def op8_decontamination(spark, sf_dir: str) -> DataFrame:
    """doc_id, item_id, score, item_words, word_from and word_to of every benchmark item found in a document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return contaminated(docs, items).select(F.col("__cs_id").alias("doc_id"), "item_id", "score", "item_words", "word_from", "word_to")
