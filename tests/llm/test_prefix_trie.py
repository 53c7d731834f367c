"""Operator 13: nodes and totals against brute force on dictionaries, and the contraction on hard trees."""

import hashlib
import random
import zlib

import duckdb
import pytest

from claimscope.llm import prefix_trie as P

SCHEMA = "conv_id long, turn long, role string, text string, depth string, node int"


def brute(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own.setdefault(c, []).append((turn is not None, turn or 0, tie, role, text))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    nodes = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for path in nodes:
        if path:
            children.setdefault(path[:-1], []).append(path)
    leaves, saved = {}, {}
    for path in sorted(nodes, key=len, reverse=True):
        below = children.get(path, [])
        leaves[path] = sum(leaves[x] for x in below) if below else 1
        own_part = (len(nodes[path]) - 1) * len(path[-1][1].encode()) if path else 0
        saved[path] = own_part + sum(saved[x] for x in below)
    out = []
    for path, members in nodes.items():
        ends = ",".join(map(str, sorted(c for c in members if len(built[c]) == len(path))))
        parent = min(nodes[path[:-1]]) if path else None
        out.append((min(members), len(path), parent, len(members), len(children.get(path, [])), leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def run(spark, rows, partitions=3):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(partitions)
    return sorted((tuple(r[c] for c in COLUMNS) for r in P.prefix_trie(df).collect()), key=str)


def test_equals_brute_force(spark):
    rng = random.Random(13)
    texts = ["a", "b", "é", "", None, "a b"]
    rows = [(c, t if rng.random() > 0.05 else None, rng.choice(["u", "s", None]), rng.choice(texts)) for c in rng.sample(range(150), 60) for t in range(rng.randrange(1, 14))]
    rows += rows[:40]  # repeated rows
    rows += [(1000 + k, t, "u", "same") for k in range(20) for t in range(k % 4 + 1)]  # a very common first turn
    rows += [(None, 1, "u", "nobody's")]
    assert run(spark, rows) == brute(rows)


def test_turnless_long_and_empty(spark, monkeypatch):
    monkeypatch.setattr(P, "BLOCK", 8)
    alone = next(c for c in range(1, 500) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 2)
    rows = [(alone, 0, "u", "x"), (alone, 1, "s", "y")]  # no base, all own turns replaced
    assert len(brute(rows)) == 1
    rows += [(505, t, "u", "again") for t in range(20)] + [(510, t, "u", f"{t}" * 3) for t in range(30)] + [(515, 0, "u", "z" * 200_000)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


@pytest.mark.parametrize("shape", ["chain", "random"])
def test_totals_of_trees(spark, shape):
    rng = random.Random(1)
    n = 60
    up = {"chain": lambda k: k - 1, "random": lambda k: rng.randrange(k)}[shape]
    parent = [None] + [up(k) for k in range(1, n)]
    a = [rng.randrange(10) for _ in range(n)]
    total, size = a[:], [1] * n
    for k in range(n - 1, 0, -1):
        total[parent[k]] += total[k]
        size[parent[k]] += size[k]
    tree = spark.createDataFrame(list(zip(range(n), parent, a, [1] * n, strict=True)), "node long, parent long, a long, b long")
    got = sorted(map(tuple, P.subtree_totals(tree, ["a", "b"]).collect()))
    assert got == list(zip(range(n), total, size, strict=True))


def test_digest_over_pieces(spark, monkeypatch):
    ends = spark.createDataFrame([(bytearray(b"k"), c) for c in range(9000, -1, -1)] + [(bytearray(b"m"), -5), (bytearray(b""), 7)], "key binary, conv long").repartition(5)
    got = {bytes(r["key"]): r["ends_sha256"] for r in P.end_digests(ends).collect()}
    assert got == {k: hashlib.sha256(v.encode()).hexdigest() for k, v in [(b"k", ",".join(map(str, range(9001)))), (b"m", "-5"), (b"", "7")]}


def test_query_equals_duckdb(spark, sf_small):
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{sf_small}/conversations.parquet'")
    want = sorted(con.sql(P.OP13_SQL).fetchall(), key=str)
    assert sorted(map(tuple, P.op13_prefix_trie(spark, sf_small).collect()), key=str) == want
