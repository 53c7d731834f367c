"""Operator 2: WARC archives, written and read with the boundary chain verified.

Writing: records go out through Spark's text writer, whose line separator is the blank lines that end a record.  Of
records with equal payloads of at least ``MIN_REVISIT`` bytes that with the largest id is the response, the others
are revisits without a payload that refer to it.

Reading: Spark's text reader splits the archives at the magic ``WARC/1.0`` wherever it stands, also inside payloads,
so a file of any size is read in splits.  Each piece is a candidate record; its header names the offset of its
successor.  Candidates that follow each other without a gap form runs (a split's first candidate and every target of
a jump begin a run), and pointer jumping over the runs from each file's start, which doubles the distance in each
round, keeps what is reachable.  A magic inside a payload starts no reachable run, and the pieces it cuts off are
joined to their record again.  Payloads are never shuffled except those of records cut in this way.

Scale: windows span one split of one file; the table of runs has about a row for each split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimscope.llm.common import new_folder, text_or_empty, written

MAGIC, BREAK, END = "WARC/1.0\r\n", "\r\n", "\r\n\r\n"
MIN_REVISIT = 1000
BLOCK = 1 << 16  # bytes; pieces meet the records that cover their block of the file
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
RECORD_ID = "urn:claimscope:page:"


def revisits(pages: DataFrame, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """``page_id``, ``digest``, ``refers_to`` of the records that repeat the payload of one with a larger id.

    Rows that repeat id and payload are all of one type.  A null id is less than any other.
    """
    seen = pages.select("page_id", F.sha1("html").alias("digest"), F.octet_length("html").alias("bytes")).where(F.col("bytes") >= min_bytes)
    groups = seen.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n"))
    groups = written(groups.where("n > 1 and refers_to is not null").drop("n"), "payload-groups")
    out = seen.select("page_id", "digest").distinct().join(groups, "digest")
    return out.where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("page_id", "digest", "refers_to")


def header(name: str, value: Column) -> Column:
    """Header line, or nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(name + ": "), value.cast("string"), F.lit(BREAK)), F.lit(""))


def records(pages: DataFrame) -> DataFrame:
    """One column ``value``: the text of each page's record without the blank lines after it."""
    src = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), text_or_empty("html").alias("html"))
    again = written(revisits(src), "revisits").select(F.col("page_id").alias("r_id"), F.col("digest").alias("r_digest"), "refers_to")
    src = src.withColumn("digest", F.sha1("html"))
    # the planner broadcasts the revisits if the size of their files allows, else it shuffles
    src = src.join(again, src.page_id.eqNullSafe(again.r_id) & (src.digest == again.r_digest), "left")
    is_revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK" + BREAK + "Content-Type: text/html; charset=utf-8" + BREAK), header("Content-Length", F.octet_length("html")), F.lit(BREAK))
    block = F.octet_length(http) + F.when(is_revisit, 0).otherwise(F.octet_length("html"))
    link = lambda c: F.concat(F.lit(f"<{RECORD_ID}"), F.col(c).cast("string"), F.lit(">"))
    lines = [
        header("WARC-Type", F.when(is_revisit, "revisit").otherwise("response")),
        header("WARC-Record-ID", link("page_id")),
        header("WARC-Target-URI", F.regexp_replace("url", "[\r\n]", " ")),
        header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        header("WARC-Refers-To", link("refers_to")),
        header("WARC-Profile", F.when(is_revisit, F.lit(PROFILE))),
        header("Content-Type", F.lit("application/http; msgtype=response")),
        header("Content-Length", block),
    ]
    return src.select(F.concat(F.lit(MAGIC), *lines, F.lit(BREAK), http, F.when(is_revisit, "").otherwise(F.col("html"))).alias("value"))


def write_archives(pages: DataFrame, path: str) -> None:
    """Write one archive file for each task to ``path``."""
    records(pages).write.option("lineSep", END).text(path)


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """``file``, ``split`` (its offset), ``seq`` (order within the split) and ``value`` of what stands between magics."""
    raw = spark.read.option("lineSep", MAGIC).text(path)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("seq"), "value")


def parsed(value: Column) -> dict[str, Column]:
    """Fields of a record's text after its magic; the successor's distance is null if the header is not whole."""
    head = F.substring_index(value, END, 1)
    both = F.substring_index(value, END, 2)
    field = lambda name, text=head: F.nullif(F.regexp_extract(F.concat(F.lit(BREAK), text), f"(?i)\r\n{name}:[ \t]*([^\r\n]*)", 1), F.lit(""))
    content = field("Content-Length").try_cast("bigint")
    start = F.octet_length(head) + 4
    body = F.octet_length(both) + 4
    payload = F.substring(value.cast("binary"), body + 1, (content - (body - start)).cast("int"))
    return {
        "size": F.octet_length(value),
        "distance": F.when(F.octet_length(head) < F.octet_length(value), len(MAGIC) + start + content + len(END)),
        "record_type": field("WARC-Type"),
        "page_id": F.regexp_extract(field("WARC-Record-ID"), f"^<{RECORD_ID}(-?[0-9]+)>$", 1).try_cast("bigint"),
        "url": field("WARC-Target-URI"),
        "refers_to": F.regexp_extract(field("WARC-Refers-To"), f"^<{RECORD_ID}(-?[0-9]+)>$", 1).try_cast("bigint"),
        "stated_digest": F.regexp_extract(field("WARC-Payload-Digest"), "^sha1:([0-9a-f]{40})$", 1),
        "stated_bytes": F.regexp_extract(F.substring(both, F.length(head) + 1, F.length(both)), "(?i)\r\nContent-Length:[ \t]*([0-9]+)", 1).try_cast("bigint"),
        "payload": payload,
    }


def candidates(found: DataFrame) -> DataFrame:
    """One row for each piece, without its text but with what a record that is not cut has, and ``at``, ``next``:
    offsets of its magic and of its successor.  The piece before a file's first magic is left out."""
    fields = parsed(F.col("value"))
    payload = fields.pop("payload")
    flat = found.select("file", "split", "seq", *[c.alias(n) for n, c in fields.items()], F.sha1(payload).alias("digest"), F.octet_length(payload).cast("long").alias("bytes"))
    flat = written(flat, "pieces")
    totals = flat.groupBy("file", "split").agg(F.sum(F.col("size") + len(MAGIC)).alias("total"))
    before = F.coalesce(F.sum("total").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = totals.select("file", "split", before.alias("before"))
    order = Window.partitionBy("file", "split").orderBy("seq")
    inside = F.coalesce(F.sum(F.col("size") + len(MAGIC)).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = flat.withColumn("inside", inside).join(starts, ["file", "split"])
    # each piece but the first of a file stands after a magic
    out = out.withColumn("at", F.col("before") + F.col("inside") - len(MAGIC)).where("at >= 0").drop("inside", "before")
    return written(out.withColumn("next", F.col("at") + F.col("distance")), "candidates")


def reachable(found: DataFrame) -> DataFrame:
    """``file``, ``split``, ``head``, ``tail``: runs of candidates (by offset) that the chain from a file's start reaches."""
    order = Window.partitionBy("file", "split").orderBy("at")
    linked = found.select("file", "split", "at", "next", F.coalesce(F.lag("next").over(order) == F.col("at"), F.lit(False)).alias("joined"), F.lead("at").over(order).alias("following"))
    linked = written(linked, "linked")
    jumps = linked.where("next is not null and not (next <=> following)").select("file", F.col("next").alias("at"), F.lit(True).alias("target")).distinct()
    opens = (~F.col("joined")) | F.coalesce("target", F.lit(False))
    runs = linked.join(jumps, ["file", "at"], "left").withColumn("run", F.sum(opens.cast("int")).over(order))
    runs = runs.groupBy("file", "split", "run").agg(F.min("at").alias("head"), F.max("at").alias("tail"), F.max_by("next", "at").alias("next"))
    runs = written(runs.select("file", "split", "head", "tail", "next"), "runs")
    jump = runs.select("file", "head", "next")
    reached = written(runs.where("head = 0").select("file", "head"), "reached")
    count = reached.count()
    while True:
        more = reached.join(jump, ["file", "head"]).select("file", F.col("next").alias("head")).join(runs.select("file", "head"), ["file", "head"])
        reached = written(reached.union(more).distinct(), "reached")
        new = reached.count()
        if new == count:
            break
        count = new
        hop = jump.select("file", F.col("head").alias("next"), F.col("next").alias("second"))
        jump = written(jump.join(hop, ["file", "next"]).select("file", "head", F.col("second").alias("next")), "jumps")
    return runs.join(reached, ["file", "head"]).select("file", "split", "head", "tail")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Records that the boundary chain of each archive under ``path`` reaches.

    ``page_id``, ``url``, ``record_type``, ``refers_to``, ``payload_digest`` and ``payload_bytes``.  For a response
    the last two are computed from the payload that was read, for a revisit they are those the record states.
    A chain that leads nowhere ends there; what follows it in the file is not returned.
    """
    found = pieces(spark, path)
    rows = candidates(found)
    runs = reachable(rows)
    kept = rows.join(runs, ["file", "split"]).where("at between head and tail").drop("head", "tail")
    whole = F.col("next") == F.col("at") + len(MAGIC) + F.col("size")
    kept = written(kept.withColumn("whole", whole), "records")
    fields = ["page_id", "url", "record_type", "refers_to", "stated_digest", "stated_bytes", "digest", "bytes"]
    plain = kept.where("whole").select(*fields)
    cut = kept.where("not whole").select("file", F.col("at").alias("first"), F.col("next").alias("past"))
    blocks = F.sequence(F.expr(f"first div {BLOCK}"), F.expr(f"(past - 1) div {BLOCK}"))
    cut = cut.withColumn("block", F.explode(blocks))
    parts = rows.select("file", "split", "seq", "at", F.expr(f"at div {BLOCK}").alias("block")).join(cut, ["file", "block"])
    parts = parts.where("at >= first and at < past").select("file", "split", "seq", "at", "first")
    parts = written(parts, "parts")
    text = found.join(parts, ["file", "split", "seq"]).groupBy("file", "first").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]), MAGIC).alias("value"))
    again = parsed(F.col("value"))
    payload = again.pop("payload")
    joined = text.select(*[c.alias(n) for n, c in again.items()], F.sha1(payload).alias("digest"), F.octet_length(payload).cast("long").alias("bytes")).select(*fields)
    out = plain.unionByName(joined)
    stated = F.col("record_type") == "revisit"
    return out.select("page_id", "url", "record_type", "refers_to", F.when(stated, F.col("stated_digest")).otherwise(F.col("digest")).alias("payload_digest"), F.when(stated, F.col("stated_bytes")).otherwise(F.col("bytes")).alias("payload_bytes"))


def op2_warc(spark, sf_dir: str) -> DataFrame:
    """Write every page to archives in the shared folder and read them back: page_id, payload_bytes, payload_digest,
    record_type, refers_to."""
    path = new_folder(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP2_SQL = f"""
WITH src AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
  dup AS (SELECT payload_digest, payload_bytes, max(page_id) AS top FROM src WHERE payload_bytes >= {MIN_REVISIT} GROUP BY ALL)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < top THEN top END AS refers_to
FROM src LEFT JOIN dup USING (payload_digest, payload_bytes)
"""
