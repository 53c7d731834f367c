"""Operator 6: document fingerprints as Merkle trees over paragraphs and sections, in DataFrame expressions only.

A paragraph is a line; its leaves are its sentences, pieces of over 64 characters without a stop being cut there.
A paragraph's node is the hash of its leaves.  Sections are runs of paragraphs that end where a paragraph's hash
says so, hence an inserted paragraph moves no other section's bounds.  A section's node is the hash of its
paragraphs, and the root is the hash of the text's length and its sections.  Equal roots mean equal texts; where
roots differ, sections and then paragraphs whose nodes differ locate the edit.

The fingerprint is ``root|section:leaves/leaves|...``: 64 hex digits for the root, 16 for each section, 10 for each
leaf, paragraphs apart by ``/``.  Likeness is the Dice coefficient of two trees' distinct leaves.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimscope.llm.common import text_or_empty

CUT = "\u001e"
#: A leaf ends after a stop and blanks, or after 64 characters without a stop.
LEAF_END = r"([.!?][ \t\r]+|[^.!?]{64})"
SECTION_END = "4"  # a paragraph hash below it, one in four, ends a section
SECTION_DIGITS, LEAF_DIGITS = 16, 10


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, even where ``body`` uses it inside another lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def tree(text: Column) -> Column:
    """Struct of ``root``, ``sections`` (hash and 1-based first and last paragraph) and ``paragraphs`` (arrays of leaf
    hashes) of a text that is not null.  The empty text has one paragraph of one empty leaf."""

    def sha(x: Column) -> Column:
        return F.sha2(x, 256)

    def leaves(p: Column) -> Column:
        return F.transform(F.split(F.regexp_replace(p, LEAF_END, "$1" + CUT), CUT, -1), sha)

    def sections(nodes: Column) -> Column:
        size = F.size(nodes)
        ends = F.filter(F.sequence(F.lit(1), size), lambda i: (F.element_at(nodes, i) < SECTION_END) | (i == size))

        def spans(e: Column) -> Column:
            first = lambda k: F.when(k == 1, F.lit(1)).otherwise(F.element_at(e, F.greatest(k - 1, F.lit(1))) + 1)
            return F.transform(F.sequence(F.lit(1), F.size(e)), lambda k: F.struct(first(k).alias("first"), F.element_at(e, k).alias("last")))

        return bound(ends, lambda e: F.transform(spans(e), lambda s: F.struct(sha(F.array_join(F.slice(nodes, s["first"], s["last"] - s["first"] + 1), "")).alias("hash"), s["first"].alias("first"), s["last"].alias("last"))))

    def node(paragraphs: Column) -> Column:
        parts = bound(F.transform(paragraphs, lambda x: sha(F.array_join(x, ""))), sections)
        return bound(parts, lambda s: F.struct(sha(F.concat(F.char_length(text).cast("string"), F.lit(":"), F.array_join(F.transform(s, lambda x: x["hash"]), ""))).alias("root"), s.alias("sections"), paragraphs.alias("paragraphs")))

    return bound(F.transform(F.split(text, "\n", -1), leaves), node)


def fingerprint(t: Column) -> Column:
    """Text form of a tree column."""
    short = lambda x: F.substring(x, 1, LEAF_DIGITS)
    lines = lambda s: F.transform(F.slice(t["paragraphs"], s["first"], s["last"] - s["first"] + 1), lambda p: F.array_join(F.transform(p, short), ""))
    parts = F.transform(t["sections"], lambda s: F.concat(F.substring(s["hash"], 1, SECTION_DIGITS), F.lit(":"), F.array_join(lines(s), "/")))
    return F.concat(t["root"], F.lit("|"), F.array_join(parts, "|"))


def leaf_set(t: Column) -> Column:
    return F.array_distinct(F.transform(F.flatten(t["paragraphs"]), lambda x: F.substring(x, 1, LEAF_DIGITS)))


def likeness(a: Column, b: Column) -> Column:
    """Dice coefficient of two leaf sets, 1.0 for equal texts."""
    return 2.0 * F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b))


def changed_sections(a: Column, b: Column) -> Column:
    """Sections of tree ``a`` (hash, first and last paragraph) that tree ``b`` lacks; empty if the roots are equal."""
    other = F.transform(b["sections"], lambda s: s["hash"])
    return bound(other, lambda o: F.filter(a["sections"], lambda s: ~F.array_contains(o, s["hash"])))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """``id_col``, ``text_col`` and ``next``: the text of the next document by descending id, after the last the first.

    Null texts count as empty, null ids come last, equal ids follow in order of their text's hash.  Quantiles of the
    id cut the order into buckets; a bucket's first document is also handed, as a guest, to the bucket before it.  So
    each text is shuffled once and no window spans the table.  The driver sees a few numbers for each bucket.
    """
    spark = docs.sparkSession
    n = buckets or 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    src = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    cuts = src.agg(F.percentile_approx("id", [i / n for i in range(1, n)] or [0.5])).first()[0] or []
    cuts = sorted(set(cuts))
    limits = F.array(*[F.lit(c) for c in cuts]) if cuts else F.array().cast("array<bigint>")
    # bucket 1 holds the null ids
    number = F.when(F.col("id").isNull(), F.lit(1)).otherwise(F.size(F.filter(limits, lambda c: c < F.col("id"))) + 2)
    src = src.withColumn("b", number)
    top = src.groupBy("b").agg(F.max(F.struct("id", F.xxhash64("text").alias("h"))).alias("top")).orderBy("b").collect()
    if not top:
        return src.select(F.col("id").alias(id_col), F.col("text").alias(text_col), F.col("text").alias("next"))
    used = [r["b"] for r in top]
    before = dict(zip(used, used[1:] + used[:1], strict=True))  # the bucket that is read just before, in a ring
    size = len(cuts) + 2
    tops = {r["b"]: r["top"] for r in top}
    ids = F.array(*[F.lit(tops[b]["id"] if b in tops else None).cast("long") for b in range(1, size + 1)])
    hashes = F.array(*[F.lit(tops[b]["h"] if b in tops else None).cast("long") for b in range(1, size + 1)])
    guests = F.array(*[F.lit(before.get(b, b)) for b in range(1, size + 1)])
    src = src.withColumn("h", F.xxhash64("text"))
    is_top = F.element_at(ids, F.col("b")).eqNullSafe(F.col("id")) & (F.element_at(hashes, F.col("b")) == F.col("h"))
    own = F.struct(F.col("b").alias("b"), F.lit(0).alias("guest"))
    seats = F.when(is_top, F.array(own, F.struct(F.element_at(guests, F.col("b")).alias("b"), F.lit(1).alias("guest")))).otherwise(F.array(own))
    dealt = src.select("id", "text", "h", F.explode(seats).alias("s"))
    order = Window.partitionBy("s.b").orderBy("s.guest", F.desc_nulls_last("id"), F.desc("h"))
    out = dealt.withColumn("next", F.lead("text").over(order)).where("s.guest = 0")
    return out.select(F.col("id").alias(id_col), F.col("text").alias(text_col), "next")


def op6_fingerprints(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document."""
    docs = with_next(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    half = F.floor(F.char_length("text") / 2).cast("int")
    docs = docs.withColumn("edited", F.concat(F.expr("left(text, char_length(text) - cast(floor(char_length(text) / 2) as int))"), F.substring(F.col("next"), F.lit(1), half)))
    trees = docs.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), tree(F.col("text")).alias("t"), tree(F.col("edited")).alias("e"), leaf_set(tree(F.col("next"))).alias("next_leaves"))
    sets = trees.withColumns({"t_leaves": leaf_set(F.col("t")), "e_leaves": leaf_set(F.col("e"))})
    return sets.select("doc_id", "n_chars", "edited_sha256", fingerprint(F.col("t")).alias("fingerprint"), fingerprint(F.col("e")).alias("edited_fingerprint"), likeness(F.col("t_leaves"), F.col("e_leaves")).alias("near_edited"), likeness(F.col("t_leaves"), F.col("next_leaves")).alias("near_next"))


def _sql_tree(text: str, name: str) -> str:
    """CTEs that give ``name`` with doc_id, root, sec, par and the leaf set of column ``text`` of table src."""
    return f"""
  {name}_p AS (SELECT doc_id, {text} AS x, list_transform(string_split({text}, chr(10)), lambda p: list_transform(
      string_split(regexp_replace(p, '([.!?][ \\t\\r]+|[^.!?]{{64}})', '\\1' || chr(30), 'g'), chr(30)), lambda l: sha256(l))) AS par FROM src),
  {name}_n AS (SELECT *, list_transform(par, lambda l: sha256(array_to_string(l, ''))) AS nodes FROM {name}_p),
  {name}_e AS (SELECT *, list_filter(range(1, len(nodes) + 1), lambda i: nodes[i] < '{SECTION_END}' OR i = len(nodes)) AS ends FROM {name}_n),
  {name}_s AS (SELECT *, list_transform(range(1, len(ends) + 1), lambda k: {{'first': CASE WHEN k = 1 THEN 1 ELSE ends[k - 1] + 1 END, 'last': ends[k]}}) AS spans FROM {name}_e),
  {name}_h AS (SELECT *, list_transform(spans, lambda s: sha256(array_to_string(list_slice(nodes, s.first, s.last), ''))) AS hashes FROM {name}_s),
  {name} AS (SELECT doc_id, sha256(length(x)::VARCHAR || ':' || array_to_string(hashes, '')) || '|' || array_to_string(list_transform(range(1, len(spans) + 1), lambda k:
      left(hashes[k], {SECTION_DIGITS}) || ':' || array_to_string(list_transform(list_slice(par, spans[k].first, spans[k].last), lambda p: array_to_string(list_transform(p, lambda l: left(l, {LEAF_DIGITS})), '')), '/')), '|') AS fp,
      list_distinct(list_transform(flatten(par), lambda l: left(l, {LEAF_DIGITS}))) AS leaves FROM {name}_h)"""


_LIKE = "2.0::DOUBLE * len(list_intersect({0}.leaves, {1}.leaves)) / (len({0}.leaves) + len({1}.leaves))"
OP6_SQL = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
  pairs AS (SELECT doc_id, text, coalesce(lead(text) OVER (ORDER BY doc_id DESC), first_value(text) OVER (ORDER BY doc_id DESC)) AS next FROM docs),
  src AS (SELECT *, left(text, (length(text) - length(text) // 2)::BIGINT) || left(next, (length(text) // 2)::BIGINT) AS edited FROM pairs),
  {_sql_tree("text", "t").strip()},
  {_sql_tree("edited", "e").strip()},
  {_sql_tree("next", "n").strip()}
SELECT src.doc_id, length(src.text)::BIGINT AS n_chars, sha256(src.edited) AS edited_sha256, t.fp AS fingerprint, e.fp AS edited_fingerprint,
  {_LIKE.format("t", "e")} AS near_edited, {_LIKE.format("t", "n")} AS near_next
FROM src JOIN t USING (doc_id) JOIN e USING (doc_id) JOIN n USING (doc_id)
"""
