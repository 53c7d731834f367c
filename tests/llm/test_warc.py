"""WARC round trip, with magics, whole records and chains of records inside payloads."""

import hashlib

from claimscope.llm.common import new_folder
from claimscope.llm.warc import END, MAGIC, read_archives, write_archives

SCHEMA = "page_id bigint, url string, html string, file string"


def record(length, body):
    return f"{MAGIC}WARC-Type: response\r\nWARC-Record-ID: <urn:claimscope:page:99>\r\nContent-Length: {length}\r\n\r\n{body}"


def round_trip(spark, rows, partitions=2):
    path = new_folder(spark, "warc-test")
    write_archives(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(partitions, "page_id"), path)
    return read_archives(spark, path).collect()


def expected(rows):
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        same = [p for p, _, h in rows if (h or "").encode() == data and p is not None]
        top = max(same, default=None)
        again = len(data) >= 1000 and top is not None and page != top
        out.append((page, "revisit" if again else "response", top if again else None, hashlib.sha1(data).hexdigest(), len(data)))
    return sorted(out, key=str)


def got(rows):
    return sorted(((r.page_id, r.record_type, r.refers_to, r.payload_digest, r.payload_bytes) for r in rows), key=str)


def test_payloads_with_magic_null_and_copies(spark):
    inner = "HTTP/1.1 200 OK\r\n\r\nhello"
    rows = [
        (1, "http://a", "<p>plain</p>"),
        (2, "http://b\r\nX: y", "before " + MAGIC + "after"),
        (3, None, "x" + record(len(inner), inner) + END + record(len(inner), inner) + END + "tail"),
        (4, "http://d", None),
        (5, "http://e", ""),
        (6, "http://f", "é" * 600),
        (7, "http://g", "é" * 600),
        (8, "http://h", "z" * 999),
        (9, "http://i", "z" * 999),
        (None, "http://j", "é" * 600),
        (10, "http://k", MAGIC),
        (11, "http://l", END + MAGIC + END),
        (11, "http://l", END + MAGIC + END),
    ]
    for partitions in (1, 4):
        assert got(round_trip(spark, rows, partitions)) == expected(rows)


def test_chain_inside_a_payload_that_ends_at_the_next_record(spark):
    inner = "HTTP/1.1 200 OK\r\n\r\nhello"
    # the inner record's length reaches over the outer record's end, to the start of the next record
    rows = [(1, "u", "x" + record(len(inner), inner)), (2, "v", "second"), (3, "w", "third")]
    assert got(round_trip(spark, rows, 1)) == expected(rows)


def test_many_splits(spark):
    rows = [(i, "u", ("a" * (i % 50)) + (MAGIC if i % 7 == 0 else "") + "b" * 300) for i in range(400)]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        assert got(round_trip(spark, rows, 2)) == expected(rows)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_empty_table(spark):
    assert round_trip(spark, []) == []
