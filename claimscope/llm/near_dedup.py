"""Operator 4: near-duplicate groups by BagMinHash.

A document is the multiset of its runs of five words.  Weights (counts) are split into dyadic intervals [0,1), [1,2),
[2,4), ...; on each interval of each shingle runs a Poisson process in time whose rate is the interval's width, and
each of its points carries a weight and one of ``m`` signature places.  A point counts for a document if its weight
is below the shingle's count there.  A place of the signature holds the time of its first counting point, so two
documents agree in a place with a probability equal to their weighted Jaccard similarity.  Since a process is only
followed until the time by which all places are filled, a shingle costs about one draw.

Steps: (1) one pass over the texts gives each document its class (a 128-bit sum over its multiset; equal multisets,
equal class) and its band keys; (2) one representative a class goes on, so copies never meet in pairs; (3) band keys
with several representatives are buckets; each representative is compared with the most central one of the bucket
it shares most bands with, and linked documents are merged; (4) the documents of buckets that
still hold several groups are joined on their rare shingles by an exact prefix filter, and the pairs that pass it are
compared; (5) components of all links.  A link is the exact weighted Jaccard similarity of the whole texts, at least
``threshold``.  No bucket, partner or candidate is capped: two documents of one bucket are compared, or already in
one group, or provably too different.  Documents that share a common passage but are otherwise different fall into
common buckets by thousands; the prefix filter, which looks at their rare shingles, makes no pairs of them.

Miss probability at similarity 0.8 with 36 bands of 6: (1 - 0.8^6)^36 = 2e-5.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimscope.llm.common import KEY, TEXT_HASH, batch_of, column_chunks, identity, keyed_texts, lean, written
from claimscope.llm.components import components
from claimscope.llm.words import mix64, shingles, words_of

SHINGLE, BANDS, BAND_ROWS, THRESHOLD = 5, 36, 6, 0.8
GROUP = 256  # pairs of one class that a task compares in a row
_ID_BITS = 52  # bits of a shingle's hash that stand beside its text's number in one sortable word


def multisets(texts: list[str], n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, count) in order of text and shingle; at most 4096 texts."""
    w = words_of(texts)
    h, doc = shingles(w, texts, n)
    key = np.sort((doc.astype(np.uint64) << np.uint64(_ID_BITS)) | (h >> np.uint64(64 - _ID_BITS)))
    head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.append(head, len(key)))
    key = key[head]
    return (key >> np.uint64(_ID_BITS)).astype(np.int64), key & np.uint64((1 << _ID_BITS) - 1), count


def bag_signatures(doc: np.ndarray, element: np.ndarray, count: np.ndarray, n_docs: int, m: int) -> np.ndarray:
    """Signature (n_docs x m) of first-point times; a row of infinities for an empty multiset."""
    sig = np.full(n_docs * m, np.inf)
    weight = np.bincount(doc, count, n_docs)
    limit = np.full(n_docs, 0.0)
    limit[weight > 0] = m * (math.log(m) + 3) / weight[weight > 0]
    # one process for each dyadic interval below a count
    level = [np.zeros(len(doc), np.int64)]
    rows = [np.arange(len(doc))]
    k = 1
    while True:
        more = np.flatnonzero(count > 2 ** (k - 1))
        if not len(more):
            break
        rows.append(more)
        level.append(np.full(len(more), k))
        k += 1
    rows, level = np.concatenate(rows), np.concatenate(level)
    low = np.where(level == 0, 0.0, 2.0 ** (level - 1))
    width = np.where(level == 0, 1.0, low)
    seed = mix64(element[rows] * np.uint64(0x9E3779B97F4A7C15) + level.astype(np.uint64) + np.uint64(1))
    all_p = (doc[rows], seed, low, width, count[rows].astype(float))
    todo = np.flatnonzero(weight > 0)
    while len(todo):
        on = np.zeros(n_docs, bool)
        on[todo] = True
        pick = on[all_p[0]]
        d, s, lo, wd, c = (x[pick] for x in all_p)
        x = np.zeros(len(d))
        j, steps = 0, 1
        while len(d):
            ticks = np.arange(j + 1, j + steps + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)
            u = mix64((s[:, None] + ticks).ravel())
            gap = -np.log(((u >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53).reshape(len(d), steps) / wd[:, None]
            times = x[:, None] + np.cumsum(gap, axis=1)
            u = mix64(u + np.uint64(0xA24BAED4963EE407)).reshape(len(d), steps)
            place = ((u >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
            at = lo[:, None] + (u & np.uint64(0xFFFFFFFF)).astype(float) * 2.0**-32 * wd[:, None]
            hit = (times <= limit[d][:, None]) & (at < c[:, None])
            np.minimum.at(sig, (d[:, None] * m + place.astype(np.int64))[hit], times[hit])
            x = times[:, -1]
            go = x <= limit[d]
            d, s, lo, wd, c, x = (y[go] for y in (d, s, lo, wd, c, x))
            j += steps
            steps = min(2 * steps, 64)
        full = np.isfinite(sig.reshape(n_docs, m)[todo]).all(axis=1)
        todo = todo[~full]
        limit[todo] *= 2
    return sig.reshape(n_docs, m)


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(n_docs x bands) hashes of the signature's bands."""
    bits = sig.view(np.uint64).reshape(len(sig), bands, rows)
    h = np.broadcast_to(mix64(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)), bits.shape[:2]).copy()
    for r in range(rows):
        h = mix64(h ^ bits[:, :, r])
    return h


def class_keys(doc: np.ndarray, element: np.ndarray, count: np.ndarray, n_docs: int) -> list[bytes]:
    """16 bytes that equal multisets share."""
    parts = []
    for salt in (0x165667B19E3779F9, 0x27D4EB2F165667C5):
        v = mix64(element * np.uint64(salt) + count.astype(np.uint64))
        total = np.zeros(len(v) + 1, np.uint64)
        np.cumsum(v, out=total[1:])
        edge = np.searchsorted(doc, np.arange(n_docs + 1))
        parts.append(total[edge[1:]] - total[edge[:-1]])
    return [a + b for a, b in zip((x.tobytes() for x in parts[0].astype(">u8")), (x.tobytes() for x in parts[1].astype(">u8")), strict=True)]


def signed(docs: DataFrame, id_col: str, text_col: str, bands: int, rows: int) -> DataFrame:
    """``__cs_id``, ``__cs_key``, ``__cs_th``, ``cls`` and ``bands`` (empty for a document without shingles) of each document."""
    keyed = keyed_texts(docs, id_col, text_col)
    out = T.StructType([keyed.schema["__cs_id"], keyed.schema[KEY], keyed.schema[TEXT_HASH], T.StructField("cls", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))])

    def sign(batches):
        for b in batches:
            for i, j, texts in column_chunks(b.column("__cs_text")):
                doc, element, count = multisets(texts)
                keys = band_keys(bag_signatures(doc, element, count, j - i, bands * rows), bands, rows)
                some = np.bincount(doc, minlength=j - i) > 0
                sizes = np.zeros(j - i + 1, np.int32)
                np.cumsum(some * bands, out=sizes[1:])
                lists = pa.ListArray.from_arrays(pa.array(sizes), pa.array(keys[some].ravel().view(np.int64)))
                cls = pa.array(class_keys(doc, element, count, j - i), pa.binary())
                part = b.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([part.column(c) for c in ("__cs_id", KEY, TEXT_HASH)] + [cls, lists], names=["__cs_id", KEY, TEXT_HASH, "cls", "bands"])

    return keyed.mapInArrow(lean(sign), out)


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two multisets given as (shingles in order, counts)."""
    if not len(a[0]) or not len(b[0]):
        return float(len(a[0]) == len(b[0]))
    at = np.minimum(np.searchsorted(a[0], b[0]), len(a[0]) - 1)
    common = np.minimum(a[1][at], b[1])[a[0][at] == b[0]].sum()
    return common / (a[1].sum() + b[1].sum() - common)


def verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Of the pairs of classes (a, b) those whose texts are similar enough, with ``similarity``.

    The pairs of one ``a`` are dealt into groups of about ``GROUP``; a task meets the text of ``a`` once a group, and
    then each ``b``, so that no row holds two texts and a class in very many pairs is spread over tasks.
    """
    sizes = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("size"))
    dealt = pairs.join(sizes, "a").select("a", "b", F.expr(f"pmod(xxhash64(b), (size + {GROUP - 1}) div {GROUP})").alias("part"))
    dealt = written(dealt, "dealt")
    ones = dealt.select("a", "part").distinct().join(texts.withColumnRenamed("cls", "a"), "a").select("a", "part", F.lit(None).cast("binary").alias("b"), "__cs_text")
    others = dealt.join(texts.withColumnRenamed("cls", "b"), "b").select("a", "part", "b", "__cs_text")
    rows = ones.unionByName(others).repartition("a", "part").sortWithinPartitions("a", "part", "b")  # a's own row first

    def compare(batches):
        schema = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("similarity", pa.float64())])
        one = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        for batch in batches:
            sims = np.full(len(batch), -1.0)
            own = batch.column("b").is_null().to_pylist()
            for i, j, some in column_chunks(batch.column("__cs_text")):
                doc, element, count = multisets(some)
                edge = np.searchsorted(doc, np.arange(j - i + 1))
                for k in range(i, j):
                    bag = element[edge[k - i] : edge[k - i + 1]], count[edge[k - i] : edge[k - i + 1]]
                    if own[k]:
                        one = bag
                    else:
                        sims[k] = overlap(one, bag)
            ok = np.flatnonzero(sims >= threshold)
            yield batch_of(schema, a=batch.column("a").take(pa.array(ok)), b=batch.column("b").take(pa.array(ok)), similarity=sims[ok])

    return rows.mapInArrow(lean(compare), "a binary, b binary, similarity double")


def remaining_pairs(texts: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of ``texts`` (cls, __cs_text, root) with different roots that may be similar enough.

    Exact prefix filter: order each multiset by how many documents hold a shingle, rare ones first.  If two multisets
    are similar enough, their first common shingle stands so early in both that enough weight is left after it: in the
    first 1 - t of the larger one and the first 1 - 2t/(1 + t) of the smaller one (of its *core*).  Two documents of
    equal size that share a passage meet only if the passage makes them similar, so a template that very many documents
    share makes no pairs of them.  A shingle's pairs are made between documents outside its largest group and all
    others, never inside a group, and at least one side has the shingle in its core.
    """
    schema = pa.schema([("cls", pa.binary()), ("root", pa.binary()), ("shingle", pa.int64()), ("n", pa.int64()), ("weight", pa.int64())])

    def split(batches):
        for b in batches:
            for i, j, own in column_chunks(b.column("__cs_text")):
                doc, element, count = multisets(own)
                weight = np.bincount(doc, count, j - i).astype(np.int64)
                at = pa.array(doc + i)
                yield batch_of(schema, cls=b.column("cls").take(at), root=b.column("root").take(at), shingle=element.view(np.int64), n=count, weight=weight[doc])

    rows = written(texts.mapInArrow(lean(split), "cls binary, root binary, shingle bigint, n bigint, weight bigint"), "shingles")
    held = written(rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "frequencies")
    order = Window.partitionBy("cls").orderBy("df", "shingle")  # one document's shingles
    ranked = rows.join(held, "shingle", "left").withColumn("df", F.coalesce("df", F.lit(1)))
    ranked = ranked.withColumn("before", F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    early = ranked.where((F.col("df") > 1) & (F.col("before") <= (1 - threshold) * F.col("weight") + 1e-9))
    early = written(early.select("shingle", "cls", "root", "weight", "before"), "prefixes")
    parts = early.groupBy("shingle", "root").agg(F.count(F.lit(1)).alias("n"))
    largest = parts.groupBy("shingle").agg(F.max(F.struct("n", "root")).alias("big"), F.count(F.lit(1)).alias("groups")).where("groups > 1")
    placed = written(early.join(written(largest.select("shingle", F.col("big.root").alias("big")), "largest"), "shingle"), "placed")
    core = F.col("before") <= (1 - 2 * threshold / (1 + threshold)) * F.col("weight") + 1e-9

    def side(rows: DataFrame, x: str) -> DataFrame:
        return rows.select("shingle", F.col("cls").alias(x), F.col("root").alias(f"root_{x}"), (F.col("weight") - F.col("before")).alias(f"left_{x}"), F.col("weight").alias(f"weight_{x}"), core.alias(f"core_{x}"), (F.col("root") == F.col("big")).alias(f"big_{x}"))

    one, two = side(placed, "a"), side(placed.where("root <> big"), "b")
    needed = threshold / (1 + threshold) * (F.col("weight_a") + F.col("weight_b")) - 1e-9
    smaller_core = F.when(F.col("weight_a") < F.col("weight_b"), F.col("core_a")).when(F.col("weight_a") > F.col("weight_b"), F.col("core_b")).otherwise(F.col("core_a") & F.col("core_b"))
    near = (F.col("root_a") != F.col("root_b")) & (F.col("big_a") | (F.col("a") < F.col("b"))) & (F.least("left_a", "left_b") >= needed) & smaller_core
    pairs = [one.where("core_a").join(two, "shingle").where(near), one.where("not core_a").join(two.where("core_b"), "shingle").where(near)]
    return pairs[0].select("a", "b").union(pairs[1].select("a", "b")).distinct()


def near_duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, bands: int = BANDS, rows: int = BAND_ROWS) -> DataFrame:
    """One row for each input row: ``__cs_id``, ``__cs_key``, ``__cs_th``, ``cls`` (equal multisets), ``root`` (the
    group's class) and ``n_verified`` (pairs of its class that were compared and hold the group together; members of a
    group that were never compared with each other do not count).

    Texts that differ only in case, punctuation or white space are of one class.  Null and empty texts form one
    class.  Ties, repeated rows and repeated ids change nothing: classes and groups depend on texts alone.
    """
    signs = written(signed(docs, id_col, text_col, bands, rows), "signatures")
    reps = signs.groupBy("cls").agg(F.first("bands").alias("bands"))  # the bands are the same in the whole class
    member = written(reps.select("cls", F.explode("bands").alias("band")), "bands")
    shared = member.groupBy("band").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    member = written(member.join(shared, "band"), "buckets")
    # the most central member of a bucket shares the most buckets, weighed by size, with others
    mass = member.groupBy("cls").agg(F.sum("size").alias("mass"))
    weighed = member.join(mass, "cls")
    centre = weighed.groupBy("band").agg(F.max(F.struct("mass", "cls")).alias("centre"))
    star = member.join(centre, "band").select(F.col("centre.cls").alias("a"), F.col("cls").alias("b"), F.col("centre.mass").alias("mass")).where("a <> b")
    best = star.groupBy("b", "a").agg(F.count(F.lit(1)).alias("common"), F.max("mass").alias("mass")).groupBy("b").agg(F.max(F.struct("common", "mass", "a")).alias("best"))
    pairs = best.select(F.col("best.a").alias("a"), "b")
    wanted = member.select("cls").distinct()
    keyed = keyed_texts(docs, id_col, text_col)
    # one text of each class that stands in a bucket
    place = signs.groupBy("cls").agg(F.min(F.struct(KEY, TEXT_HASH)).alias("p")).join(wanted, "cls", "left_semi")
    texts = keyed.join(place.select("cls", f"p.{KEY}", f"p.{TEXT_HASH}"), [KEY, TEXT_HASH])
    texts = written(texts.select("cls", "__cs_text").dropDuplicates(["cls"]), "texts")
    links = written(verified(pairs, texts, threshold), "links")
    roots = components(links)
    # documents of buckets that still hold several groups
    grouped = member.join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    mixed = grouped.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("band")
    open_ = written(grouped.join(written(mixed, "mixed"), "band").select("cls", "root").distinct(), "open")
    rest = remaining_pairs(texts.join(open_, "cls"), threshold)
    more = written(verified(rest, texts, threshold), "links")
    # the groups that these links unite: components of roots, not of documents
    ends = [open_.select(F.col("cls").alias(x), F.col("root").alias(f"root_{x}")) for x in ("a", "b")]
    bridges = written(more.join(ends[0], "a").join(ends[1], "b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b")).distinct(), "bridges")
    united = components(bridges).select(F.col("node").alias("root"), F.col("root").alias("united"))
    alone = open_.where("cls = root").select(F.col("cls").alias("node"), "root")
    roots = roots.unionByName(alone).distinct().join(united, "root", "left").select("node", F.coalesce("united", "root").alias("root"))
    degree = links.unionByName(more).select(F.explode(F.array("a", "b")).alias("cls")).groupBy("cls").agg(F.count(F.lit(1)).alias("n_verified"))
    known = written(roots.withColumnRenamed("node", "cls").join(degree, "cls"), "known")
    out = signs.drop("bands").join(known, "cls", "left")
    return out.withColumns({"root": F.coalesce("root", "cls"), "n_verified": F.coalesce("n_verified", F.lit(0))})


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row of ``docs`` for each near-duplicate group: that with the least id (a null id comes last).

    Ties of id are broken by the hash of the text; of rows that repeat id and text any one stays.
    """
    groups = near_duplicate_groups(docs, id_col, text_col, **how)
    first = groups.groupBy("root").agg(F.min(F.struct(F.col("__cs_id").isNull(), F.col("__cs_id"), F.col(TEXT_HASH), F.col(KEY))).alias("p"))
    kept = written(first.select(F.col(f"p.{KEY}").alias(KEY), F.col(f"p.{TEXT_HASH}").alias(TEXT_HASH)), "kept")
    return docs.withColumns(dict(zip((KEY, TEXT_HASH), identity(id_col, text_col), strict=True))).join(kept, [KEY, TEXT_HASH]).dropDuplicates([KEY, TEXT_HASH]).select(*docs.columns)


def op4_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document with its group: doc_id, class_id (hex, equal texts up to case and punctuation), group_id (least
    doc_id of the group), group_size, n_verified (pairs of its class that were
    compared and hold the group together, not all similar texts) and keep."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = written(near_duplicate_groups(docs), "groups")
    groups = written(rows.groupBy("root").agg(F.min("__cs_id").alias("group_id"), F.count(F.lit(1)).alias("group_size")), "sizes")
    out = rows.join(groups, "root")
    return out.select(F.col("__cs_id").alias("doc_id"), F.lower(F.hex("cls")).alias("class_id"), "group_id", "group_size", "n_verified", F.col("__cs_id").eqNullSafe(F.col("group_id")).alias("keep"))
