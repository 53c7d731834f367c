"""Operator 13: prefix trie of conversations, with subtree totals by parallel tree contraction.

1. Turns are numbered within their conversation by their numbers in the whole table's order, not by a window over a
   conversation; conversations are rebuilt from the first turns of their base.
2. A node's key is the digest of its depth and of four running sums of 32 bits of each turn's digest at its depth.  The
   sums run over blocks of 1024 turns, and then over the blocks of a conversation, so that a very long conversation is
   many small windows and one window over a thousandth of its rows.
3. Nodes are the groups of equal keys; counts and least members are partial aggregates, so a very common first turn
   is added up where it is read.
4. Totals of subtrees (``subtree_totals``): rounds of *rake*, in which the leaves hand their totals to their parents,
   and *compress*, in which every node with one child left whose draw exceeds its child's and its parent's is cut out of
   its chain and leaves its own total on the child's way up.  Every round takes all leaves and about a third of all
   unary nodes, so the rounds grow with the logarithm of the number of nodes, also for chains.  The rounds are then
   taken back in reverse order: a node cut out in a round gets the total of its child, known by then, and what lay
   between them.
5. The digest of a node's ends streams over its sorted member numbers: sorted pieces of a bounded number of members,
   made in parallel, are joined in order with one running SHA-256 state a node.  SHA-256 itself has no parts that could
   be hashed apart, so the bytes of one node go through one task, without being held there.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimscope.llm.common import numbered, read_table, text_or_empty, written

BLOCK, PIECE = 1024, 4096
BASE_OF, HEAD = 5, 9  # a conversation's base is the next lower multiple; its head has fewer turns than HEAD
NO_ENDS = hashlib.sha256(b"").hexdigest()


def _lanes(digest: Column) -> list[Column]:
    """Four numbers of 32 bits of a hexadecimal MD5."""
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long").alias(f"s{k}") for k in range(4)]


def rebuilt_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (``conv``, ``d`` from 1, ``turn_digest``, ``bytes``) of the rebuilt conversations, and the conversations
    (``conv``, ``length`` in rebuilt turns, which may be 0).

    Rows without a conv_id belong to no conversation.  Turns of one number stand in the order of their digests.
    """
    role, text = text_or_empty("role"), text_or_empty("text")
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    src = conversations.where(F.col("conv_id").isNotNull())
    src = src.select(F.col("conv_id").cast("long").alias("conv"), F.col("turn"), digest.alias("turn_digest"), F.octet_length(text).cast("long").alias("bytes"))
    rows = numbered(src, ["conv", "turn", "turn_digest"], "turns")
    sizes = written(rows.groupBy("conv").agg(F.min("__cs_row").alias("first"), F.count(F.lit(1)).alias("n")), "conversations")
    turns = written(rows.join(sizes, "conv").select("conv", (F.col("__cs_row") - F.col("first")).alias("pos"), "turn_digest", "bytes"), "turns")
    head = (F.crc32(F.col("conv").cast("string").cast("binary")) % HEAD).alias("h")
    base = (F.col("conv") - F.pmod("conv", F.lit(BASE_OF))).alias("base")
    convs = sizes.select("conv", "n", base, head)
    theirs = sizes.select(F.col("conv").alias("base"), F.col("n").alias("base_n"))
    convs = convs.join(theirs, "base", "left").select("conv", "base", "n", "h", F.least("h", F.coalesce("base_n", F.lit(0))).alias("taken"))
    convs = written(convs.withColumn("length", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))), "rebuilt")
    heads = turns.where(F.col("pos") < HEAD - 1).withColumnRenamed("conv", "base")
    lent = convs.select("conv", "base", "taken").join(heads, "base").where("pos < taken").select("conv", (F.col("pos") + 1).alias("d"), "turn_digest", "bytes")
    own = turns.join(convs.select("conv", "h", "taken"), "conv").where("pos >= h")
    own = own.select("conv", (F.col("pos") - F.col("h") + F.col("taken") + 1).alias("d"), "turn_digest", "bytes")
    return lent.unionByName(own), convs.select("conv", "length")


def prefixes(turns: DataFrame) -> DataFrame:
    """``conv``, ``d``, ``bytes``, ``key`` and ``parent_key`` (16 bytes each; null below the root) of every turn."""
    at_depth = F.md5(F.concat(F.col("d").cast("string"), F.lit(":"), "turn_digest").cast("binary"))
    rows = turns.select("conv", "d", "bytes", F.expr(f"(d - 1) div {BLOCK}").alias("block"), at_depth.alias("x"))
    rows = rows.select("conv", "d", "bytes", "block", *_lanes(F.col("x")))
    rows = written(rows, "lanes")
    blocks = rows.groupBy("conv", "block").agg(*[F.sum(f"s{k}").alias(f"s{k}") for k in range(4)])
    before = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("conv", "block", *[F.coalesce(F.sum(f"s{k}").over(before), F.lit(0)).alias(f"b{k}") for k in range(4)])
    within = Window.partitionBy("conv", "block").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    runs = rows.select("conv", "block", "d", "bytes", *[f"s{k}" for k in range(4)], *[F.sum(f"s{k}").over(within).alias(f"r{k}") for k in range(4)])
    runs = runs.join(blocks, ["conv", "block"])

    def key(depth: Column, sums: list[Column]) -> Column:
        return F.unhex(F.md5(F.concat_ws(",", depth.cast("string"), *[s.cast("string") for s in sums]).cast("binary")))

    own = [F.col(f"r{k}") + F.col(f"b{k}") for k in range(4)]
    up = [F.col(f"r{k}") + F.col(f"b{k}") - F.col(f"s{k}") for k in range(4)]
    parent = F.when(F.col("d") > 1, key(F.col("d") - 1, up))
    return runs.select("conv", "d", "bytes", key(F.col("d"), own).alias("key"), parent.alias("parent_key"))


def subtree_totals(tree: DataFrame, sums: list[str]) -> DataFrame:
    """``node`` and the totals of ``sums`` (long) over its subtree, the node included, for every row of ``tree``
    (``node``: distinct long, ``parent``: null for the one root, ``sums``).  An empty tree gives an empty result.
    """
    spark = tree.sparkSession
    size = tree.groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("kids")).where("node is not null")
    alive = tree.join(size, "node", "left").select("node", "parent", F.coalesce("kids", F.lit(0)).alias("kids"), *sums, *[F.lit(0).cast("long").alias(f"way_{s}") for s in sums], F.lit(None).cast("long").alias("cut"), *[F.lit(0).cast("long").alias(f"cut_{s}") for s in sums])
    rounds = [written(alive, "tree")]
    leaf = F.col("kids") == 0
    while not rounds[-1].where("parent is not null").isEmpty():
        last = rounds[-1].drop("cut", *[f"cut_{s}" for s in sums])
        # rake: what the leaves hand up, and the children that are left
        hand = [F.sum(F.when(leaf, F.col(s) + F.col(f"way_{s}")).otherwise(0)).alias(f"up_{s}") for s in sums]
        left = [F.count(F.when(~leaf, 1)).alias("left"), F.min(F.when(~leaf, F.col("node"))).alias("only")]
        up = last.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(*hand, *left)
        kept = last.where(~leaf).join(up, "node").drop("kids").withColumnRenamed("left", "kids")
        kept = kept.withColumns({s: F.col(s) + F.col(f"up_{s}") for s in sums}).drop(*[f"up_{s}" for s in sums])
        # compress: unary nodes whose draw is above those of their neighbours
        draw = lambda c: F.xxhash64(F.col(c), F.lit(len(rounds)))
        out = (F.col("kids") == 1) & F.col("parent").isNotNull() & (draw("node") > draw("only")) & (draw("node") > draw("parent"))
        kept = written(kept.withColumn("out", F.coalesce(out, F.lit(False))), "raked")
        gone = kept.where("out").select(F.col("only").alias("node"), F.col("node").alias("cut"), F.col("parent").alias("new_parent"), *[F.col(s).alias(f"own_{s}") for s in sums], *[F.col(f"way_{s}").alias(f"on_{s}") for s in sums])
        rest = kept.where("not out").join(gone, "node", "left")
        below = {f"cut_{s}": F.col(f"way_{s}") + F.coalesce(f"own_{s}", F.lit(0)) for s in sums}
        rest = rest.select("node", F.coalesce("new_parent", "parent").alias("parent"), "kids", *sums, *[(below[f"cut_{s}"] + F.coalesce(f"on_{s}", F.lit(0))).alias(f"way_{s}") for s in sums], "cut", *[c.alias(n) for n, c in below.items()])
        rounds.append(written(rest, "tree"))
    known = rounds[-1].select("node", *sums)  # the root
    for k in range(len(rounds) - 1, 0, -1):
        raked = rounds[k - 1].where(leaf & F.col("parent").isNotNull()).select("node", *sums)
        cut = rounds[k].where("cut is not null").select("node", "cut", *[f"cut_{s}" for s in sums])
        cut = cut.join(known, "node").select(F.col("cut").alias("node"), *[(F.col(s) + F.col(f"cut_{s}")).alias(s) for s in sums])
        known = written(known.unionByName(raked).unionByName(cut), "totals")
    return known


def end_digests(ends: DataFrame) -> DataFrame:
    """``key`` and ``ends_sha256`` of the members (``conv``) of every key in ``ends``."""
    ends = written(ends.select("key", "conv"), "ends")
    ordered = ends.repartitionByRange("key", "conv").sortWithinPartitions("key", "conv")

    def pieces(batches):
        for b in batches:
            keys, convs = b.column("key").to_pylist(), b.column("conv").to_pylist()
            cuts = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)]
            cuts = [i for a, z in zip(cuts, cuts[1:], strict=False) for i in range(a, z, PIECE)] + [len(keys)]
            parts = list(zip(cuts, cuts[1:], strict=False))
            cols = [pa.array([keys[a] for a, _ in parts], pa.binary()), pa.array([convs[a] for a, _ in parts], pa.int64()), pa.array([",".join(map(str, convs[a:z])) for a, z in parts], pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=["key", "first", "members"])

    def digest(batches):
        key, state = None, None
        for b in batches:
            done = []
            for k, members in zip(b.column("key").to_pylist(), b.column("members").to_pylist(), strict=True):
                if k == key:
                    state.update(b",")
                else:
                    if key is not None:
                        done.append((key, state.hexdigest()))
                    key, state = k, hashlib.sha256()
                state.update(members.encode())
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.binary()), pa.array([x[1] for x in done], pa.string())], names=["key", "ends_sha256"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()], pa.string())], names=["key", "ends_sha256"])

    small = ordered.mapInArrow(pieces, "key binary, first bigint, members string")
    return small.repartition("key").sortWithinPartitions("key", "first").mapInArrow(digest, "key binary, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row for each node of the trie of rebuilt conversations; see the module and ``op13_prefix_trie``.

    Null roles and texts are empty; a null turn number comes first; repeated rows are turns of their own; rows without
    a conv_id are left out; other columns are not looked at.  No conversation, no node: an empty table gives an empty
    result.
    """
    turns, convs = rebuilt_turns(conversations)
    rows = written(prefixes(turns), "prefixes")
    convs = written(convs, "lengths")
    root = convs.agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv").alias("conv_id")).where("n_convs > 0")
    root = root.select(F.lit(None).cast("binary").alias("key"), F.lit(None).cast("binary").alias("parent_key"), F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("bytes"), "n_convs", "conv_id")
    nodes = rows.groupBy("key", "parent_key", F.col("d").alias("depth"), "bytes").agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv").alias("conv_id"))
    nodes = root.unionByName(nodes.select(root.columns)).withColumn("node", F.monotonically_increasing_id())
    nodes = written(nodes, "nodes")
    ends = rows.join(convs, "conv").where("d = length").select("key", "conv")
    no_turns = convs.where("length = 0").select(F.lit(b"").alias("key"), "conv")  # the root's ends
    digests = written(end_digests(ends.unionByName(no_turns)), "digests")
    top = nodes.where("depth = 0").select(F.col("node").alias("root_node"), F.col("conv_id").alias("root_conv"))
    parents = nodes.where("depth > 0").select(F.col("key").alias("parent_key"), F.col("node").alias("parent_node"), F.col("conv_id").alias("parent_conv"))
    below = nodes.join(parents, "parent_key", "left").join(F.broadcast(top))  # one row
    first = F.col("depth") == 1
    below = below.withColumns({"parent": F.when(first, F.col("root_node")).otherwise(F.col("parent_node")), "parent_conv_id": F.when(first, F.col("root_conv")).otherwise(F.col("parent_conv"))})
    below = written(below.select("node", "parent", "key", "depth", "conv_id", "parent_conv_id", "n_convs", "bytes"), "tree")
    size = written(below.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children")), "children")
    tree = below.join(size, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    tree = written(tree, "tree")
    totals = subtree_totals(tree.select("node", "parent", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens")), ["n_leaves", "saved_tokens"])
    out = tree.withColumn("key", F.coalesce("key", F.lit(b""))).join(totals, "node").join(digests, "key", "left")
    return out.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_ENDS)))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    out = prefix_trie(read_table(spark, sf_dir, "conversations"))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


#: Rebuilt conversations as lists; a node is a digest chain; totals come from all pairs of a node and those above it.
OP13_SQL = """
WITH RECURSIVE crc_table AS (
  SELECT list_transform(range(256), lambda x: list_reduce(list_prepend(x, range(8)), lambda c, y: xor(c >> 1, 3988292384 * (c & 1)))) AS t
), turns AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT c, n, c - c % 5 AS base, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(c::VARCHAR, '.'), lambda x: ascii(x)::BIGINT)),
    lambda s, y: xor(s >> 8, t[(xor(s, y) & 255) + 1]))) % 9 AS h
  FROM (SELECT c, count(*) AS n FROM turns GROUP BY c), crc_table
), sized AS (
  SELECT convs.*, least(h, coalesce(b.m, 0)) AS taken FROM convs LEFT JOIN (SELECT c AS bc, n AS m FROM convs) b ON b.bc = convs.base
), rebuilt AS (
  SELECT s.c, t.pos + 1 AS d, role, text FROM sized s JOIN turns t ON t.c = s.base AND t.pos < s.taken
  UNION ALL
  SELECT s.c, t.pos - s.h + s.taken + 1 AS d, role, text FROM sized s JOIN turns t ON t.c = s.c AND t.pos >= s.h
), lengths AS (
  SELECT s.c, coalesce(max(d), 0) AS len FROM sized s LEFT JOIN rebuilt r ON r.c = s.c GROUP BY s.c
), chain(c, d, k, pk, bytes) AS (
  SELECT c, 0::BIGINT, '', NULL::VARCHAR, 0::BIGINT FROM lengths
  UNION ALL
  SELECT r.c, r.d, md5(k || '|' || length(role) || '|' || role || '|' || text), k, octet_length(encode(text))::BIGINT
  FROM chain JOIN rebuilt r ON r.c = chain.c AND r.d = chain.d + 1
), nodes AS (
  SELECT d, k, any_value(pk) AS pk, any_value(bytes) AS bytes, count(*) AS n_convs, min(c) AS conv_id FROM chain GROUP BY d, k
), children AS (
  SELECT d - 1 AS d, pk AS k, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL
), full_nodes AS (
  SELECT nodes.*, coalesce(n, 0) AS n_children FROM nodes LEFT JOIN children USING (d, k)
), totals AS (
  SELECT up.d, up.k, sum((f.n_children = 0)::INTEGER) AS n_leaves, sum((f.n_convs - 1) * f.bytes) AS saved
  FROM full_nodes f JOIN chain up ON up.c = f.conv_id AND up.d <= f.d GROUP BY up.d, up.k
), ends AS (
  SELECT d, k, string_agg(chain.c::VARCHAR, ',' ORDER BY chain.c) AS s FROM chain JOIN lengths ON lengths.c = chain.c AND d = len GROUP BY d, k
)
SELECT f.conv_id, f.d::BIGINT AS depth, p.conv_id AS parent_conv_id, f.n_convs::BIGINT AS n_convs, f.n_children::BIGINT AS n_children,
  n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(coalesce(s, '')) AS ends_sha256
FROM full_nodes f LEFT JOIN full_nodes p ON p.d = f.d - 1 AND p.k = f.pk
JOIN totals t ON t.d = f.d AND t.k = f.k LEFT JOIN ends e ON e.d = f.d AND e.k = f.k
"""
