"""Provider / patient / physician graph as two DataFrames.

Vertices are ``(id, type)``, edges ``(src, dst, ...)``.  Iterative algorithms
(PageRank, label propagation) are joins + grouped aggregations per round:

* parallel edges are collapsed to weighted edges once, before iterating
  (a hub's many claims become one weighted row per neighbour);
* the weighted edges are hash-partitioned by source once and reused, so each
  round shuffles only the messages;
* a hub's edges are cut into parts of about ``HUB_EDGES`` and dealt over all
  partitions; its one state a round is copied to each part (a vertex cut);
* messages are summed with map-side partial aggregation (hub vertices are
  pre-aggregated per task);
* lineage is cut with a reliable ``checkpoint()`` (written to the folder in
  ``spark.checkpoint.dir``) every few rounds, so a lost executor recomputes at
  most a few rounds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimscope.functions.values import (
    NODE_COLOR_FRAUD,
    NODE_COLOR_OTHER,
    NODE_SIZE_FRAUD,
    NODE_SIZE_OTHER,
    REL_AFFILIATED,
    REL_ATTENDED,
    REL_OPERATED,
    REL_TREATS,
    REL_USED_PROVIDER,
    REL_VISITED,
    VERTEX_DOCTOR,
    VERTEX_PATIENT,
    VERTEX_PROVIDER,
)
from claimscope.operators.windows import hot_keys
from claimscope.session import ensure_checkpoint_dir

HUB_EDGES = 100_000  # a vertex with more neighbours is cut into parts of about this many
BROADCAST_HUBS = 10**6  # so many hubs are broadcast, more are joined by a shuffle

PHYS = ["AttendingPhysician", "OperatingPhysician", "OtherPhysician"]


def _vertex(col: str, kind: str) -> Column:
    return F.struct(F.col(col).cast("string").alias("id"), F.lit(kind).alias("type"))


# G1
def bipartite_vertices(claims: DataFrame) -> DataFrame:
    """Distinct patients and providers, one scan."""
    v = claims.select(F.inline(F.array(_vertex("BeneID", VERTEX_PATIENT), _vertex("Provider", VERTEX_PROVIDER))))
    return v.distinct()


# G2
def bipartite_edges(claims: DataFrame) -> DataFrame:
    """One patient -> provider edge per claim (parallel edges kept), with the
    provider label if the claims have it."""
    label = ["PotentialFraud"] if "PotentialFraud" in claims.columns else []
    return claims.selectExpr(
        "BeneID as src", "Provider as dst", "InscClaimAmtReimbursed", "ClaimStartDt", "ClaimEndDt", *label
    )


# G3
def tripartite_vertices(claims: DataFrame) -> DataFrame:
    """Patients, doctors (three physician columns) and providers; null ids
    dropped."""
    parts = [_vertex("BeneID", VERTEX_PATIENT)] + [_vertex(c, VERTEX_DOCTOR) for c in PHYS] + [
        _vertex("Provider", VERTEX_PROVIDER)
    ]
    return claims.select(F.inline(F.array(*parts))).where(F.col("id").isNotNull()).distinct()


def _edge(src: str, dst: str, rel: str) -> Column:
    return F.struct(
        F.col(src).cast("string").alias("src"), F.col(dst).cast("string").alias("dst"), F.lit(rel).alias("relationship")
    )


# G4
def tripartite_edges(claims: DataFrame) -> DataFrame:
    """Seven edge families from one scan; edges with a null end dropped."""
    fams = [_edge("BeneID", p, REL_VISITED) for p in PHYS]
    fams += [_edge(p, "Provider", REL_AFFILIATED) for p in PHYS]
    fams.append(_edge("BeneID", "Provider", REL_USED_PROVIDER))
    return claims.select(F.inline(F.array(*fams))).dropna(subset=["src", "dst"])


# G5
PROVIDER_EDGE_COLS = ["Provider", "BeneID", "AttendingPhysician", "OperatingPhysician", "PotentialFraud"]


def complete_rows(claims: DataFrame) -> DataFrame:
    """Claims with all five graph fields present, as text."""
    return claims.select(*[F.col(c).cast("string").alias(c) for c in PROVIDER_EDGE_COLS]).dropna(how="any")


def provider_edges(claims: DataFrame) -> DataFrame:
    """Provider-centred edges (treats_patient, attended_by, operated_by) from
    the complete rows; empty ids give no edge."""
    rows = complete_rows(claims)
    fams = [
        _edge("Provider", "BeneID", REL_TREATS),
        _edge("Provider", "AttendingPhysician", REL_ATTENDED),
        _edge("Provider", "OperatingPhysician", REL_OPERATED),
    ]
    return rows.select(F.inline(F.array(*fams))).where(F.length("dst") > 0)


# G6
def fraud_ids(claims: DataFrame) -> DataFrame:
    rows = complete_rows(claims)
    return rows.where(F.col("PotentialFraud") == "Yes").select(F.col("Provider").alias("id")).distinct()


def node_attributes(edges: DataFrame, fraud: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Every node of ``edges`` (per ``keys`` group, e.g. a sample chunk) with
    its fraud flag, colour and size."""
    keys = keys or []
    nodes = edges.select(*keys, F.explode(F.array("src", "dst")).alias("id")).distinct()
    flagged = nodes.join(fraud.withColumn("_f", F.lit(True)), on="id", how="left")
    is_fraud = F.coalesce(F.col("_f"), F.lit(False))
    return flagged.select(
        *keys, "id", is_fraud.alias("is_fraud"),
        F.when(is_fraud, F.lit(NODE_COLOR_FRAUD)).otherwise(F.lit(NODE_COLOR_OTHER)).alias("color"),
        F.when(is_fraud, F.lit(NODE_SIZE_FRAUD)).otherwise(F.lit(NODE_SIZE_OTHER)).alias("size"),
    )


# G7
def degrees(edges: DataFrame) -> DataFrame:
    """In + out degree per vertex (parallel edges counted)."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id"))
    return ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _cut(df: DataFrame, round_no: int, every: int, last: int) -> DataFrame:
    """Reliable checkpoint every ``every`` rounds and after the last round."""
    if round_no == last or (every and round_no % every == 0):
        ensure_checkpoint_dir(df.sparkSession)
        return df.checkpoint(eager=True)
    return df


class HubCut:
    """Edges ``(key, other, m)`` laid out for rounds that send a state along them.

    ``light`` holds the edges of ordinary vertices, hash-partitioned by ``key``.  ``heavy`` holds those of hubs (more
    than ``hub_edges`` edges), hash-partitioned by ``key`` and a part number drawn from the other end, so that a hub's
    edges lie in all partitions.  There are at most edges / ``hub_edges`` hubs and as many copies of their states."""

    def __init__(self, edges: DataFrame, key: str, other: str, hub_edges: int = HUB_EDGES) -> None:
        n = _partitions(edges)
        self.key, self.heavy = key, None
        self.edges = edges.persist()
        hubs = hot_keys(self.edges, [key], hub_edges).withColumnRenamed("_k0", key)
        rest = self.edges
        if not hubs.isEmpty():
            fans = self.edges.join(hubs, key, "left_semi").groupBy(key).agg(F.count(F.lit(1)).alias("fan"))
            hubs = fans.select(key, F.ceil(F.col("fan") / hub_edges).alias("parts")).checkpoint()
            self.hubs = F.broadcast(hubs) if hubs.count() <= BROADCAST_HUBS else hubs
            rest = rest.join(self.hubs, key, "left_anti")
            heavy = self.edges.join(self.hubs, key).withColumn("part", F.pmod(F.xxhash64(other), F.col("parts")))
            self.heavy = heavy.drop("parts").repartition(n, key, "part").persist()
        self.light = rest.repartition(n, key).persist()

    def degrees(self) -> DataFrame:
        """``id`` and ``deg`` (sum of ``m``) of every key vertex; ordinary ones are counted where their edges lie."""
        sides = [self.light] if self.heavy is None else [self.light, self.heavy]
        sums = [x.groupBy(F.col(self.key).alias("id")).agg(F.sum("m").alias("deg")) for x in sides]
        return reduce(DataFrame.unionByName, sums)

    def sent(self, state: DataFrame) -> DataFrame:
        """Every edge with the columns of its key vertex in ``state`` (``id``, ...)."""
        own = state.withColumnRenamed("id", self.key)
        out = self.light.join(own, self.key)
        if self.heavy is None:
            return out
        copies = own.join(self.hubs, self.key).withColumn("part", F.explode(F.expr("sequence(0L, parts - 1)")))
        hot = self.heavy.join(copies, [self.key, "part"])
        return out.unionByName(hot.select(*out.columns))

    def release(self) -> None:
        for df in (self.light, self.heavy, self.edges):
            if df is not None:
                df.unpersist()


# G8
def pagerank(vertices: DataFrame, edges: DataFrame, reset: float = 0.15, iters: int = 10,
             checkpoint_every: int = 3, hub_edges: int = HUB_EDGES) -> DataFrame:
    """Static PageRank: start 1.0; each round
    ``rank = reset + (1 - reset) * sum(rank(src) / outdegree(src) * m(src, dst))``
    with m = number of parallel edges; finally scaled so the ranks sum to
    the number of vertices (sinks leak rank, the scaling restores it)."""
    n = _partitions(edges)
    pairs = edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull()).groupBy("src", "dst").agg(
        F.count(F.lit(1)).alias("m")
    )
    cut = HubCut(pairs, "src", "dst", hub_edges)
    ids = vertices.select("id").where(F.col("id").isNotNull()).distinct()
    ids = ids.repartition(n, "id").join(cut.degrees(), "id", "left").persist()
    ranks = ids.withColumn("rank", F.lit(1.0))
    for i in range(1, iters + 1):
        shares = ranks.select("id", (F.col("rank") / F.col("deg")).alias("share"))
        msg = cut.sent(shares).groupBy("dst").agg(F.sum(F.col("share") * F.col("m")).alias("s"))
        ranks = ids.join(msg.withColumnRenamed("dst", "id"), "id", "left").select(
            "id", "deg", (F.lit(reset) + F.lit(1.0 - reset) * F.coalesce(F.col("s"), F.lit(0.0))).alias("rank")
        )
        ranks = _cut(ranks, i, checkpoint_every, iters)
    cut.release()
    ids.unpersist()
    total = ranks.agg(F.sum("rank")).scalar()
    count = ranks.agg(F.count(F.lit(1)).cast("double")).scalar()
    return ranks.select("id", (F.col("rank") * count / total).alias("pagerank"))


# G9
def label_propagation(vertices: DataFrame, edges: DataFrame, iters: int = 5, checkpoint_every: int = 1,
                      hub_edges: int = HUB_EDGES) -> DataFrame:
    """Synchronous label propagation over both edge directions: each round a
    vertex takes the label carried by most of its edges (parallel edges
    count), ties to the smallest label; vertices without edges keep their
    own id as label.  A round reads its labels twice (to send them and to keep
    those of vertices without messages), so they are written every round."""
    n = _partitions(edges)
    ends = edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull())
    pairs = ends.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("m"))
    # a pair that occurs both ways (or joins a vertex to itself) gives two rows, whose messages are added up
    both = pairs.select(F.inline(F.array(
        F.struct(F.col("src").alias("v"), F.col("dst").alias("nbr"), "m"),
        F.struct(F.col("dst").alias("v"), F.col("src").alias("nbr"), "m"),
    )))
    cut = HubCut(both, "nbr", "v", hub_edges)
    ids = vertices.select("id").where(F.col("id").isNotNull()).distinct().repartition(n, "id").persist()
    labels = ids.withColumn("label", F.col("id"))
    for i in range(1, iters + 1):
        cand = cut.sent(labels).groupBy("v", "label").agg(F.sum("m").alias("c"))
        best = cand.groupBy("v").agg(F.min_by("label", F.struct(-F.col("c"), F.col("label"))).alias("new"))
        labels = labels.join(best.withColumnRenamed("v", "id"), "id", "left").select(
            "id", F.coalesce(F.col("new"), F.col("label")).alias("label")
        )
        labels = _cut(labels, i, checkpoint_every, iters)
    cut.release()
    ids.unpersist()
    return labels


# O3
def sample_chunks(edges: DataFrame, chunk: int = 100, n_chunks: int = 2, seed: int = 42,
                  cols: list[str] | None = None) -> DataFrame:
    """Seeded shuffle of the edges, first ``chunk * n_chunks`` kept, cut into
    chunks.  The shuffle order is md5(seed | edge), so it is reproducible and
    checkable; the cut is a global top-k (per-partition top-k, then merge)."""
    cols = cols or ["src", "dst", "relationship"]
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]))
    keep = chunk * n_chunks
    top = edges.select(*cols, key.alias("_h")).orderBy("_h", *cols).limit(keep)
    # at most ``keep`` rows: numbering them in one partition is bounded
    from pyspark.sql import Window

    rn = F.row_number().over(Window.orderBy("_h", *cols))
    out = top.withColumn("rn", rn).withColumn("chunk", ((F.col("rn") - 1) / chunk).cast("int"))
    return out.drop("_h")


# G10
def simple_graph(edges: DataFrame, keys: list[str] | None = None, order: str = "rn") -> DataFrame:
    """Undirected simple graph: parallel / reversed edges merged, the last
    relationship (by ``order``) kept."""
    keys = keys or []
    u = F.least("src", "dst").alias("u")
    v = F.greatest("src", "dst").alias("v")
    return edges.groupBy(*keys, u, v).agg(F.max_by("relationship", order).alias("relationship"))


# G11
def sample_subgraphs(edges: DataFrame, fraud: DataFrame, chunk: int = 100, n_chunks: int = 2,
                     seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Two sampled subgraphs: (simple-graph edges, node attributes) per chunk."""
    s = sample_chunks(edges, chunk, n_chunks, seed)
    g = simple_graph(s, ["chunk"])
    nodes = node_attributes(g.select("chunk", F.col("u").alias("src"), F.col("v").alias("dst")), fraud, ["chunk"])
    return g, nodes
