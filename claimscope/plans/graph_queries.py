"""Registered graph queries (G1-G11, O3) over the whole claim table."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimscope.functions.values import (
    LPA_ITERS,
    PAGERANK_ITERS,
    PAGERANK_RESET,
    SEED,
    SUBGRAPH_COUNT,
    SUBGRAPH_EDGES,
)
from claimscope.operators import graph as G
from claimscope.plans.base import query, rounded
from claimscope.sources import fixture as fx


def _claims(spark, d, *sides):
    return fx.claims_with(spark, d, *sides)


BI_V = """select distinct BeneID as id, 'patient' as type from claims_full
union select distinct Provider, 'provider' from claims_full"""
BI_E = "select BeneID as src, Provider as dst from claims_full"
G5_ROWS = "select * from claims_full where Provider is not null and BeneID is not null and AttendingPhysician is not null and OperatingPhysician is not null and PotentialFraud is not null"
G5_E = f"""select * from (
  select Provider as src, BeneID as dst, 'treats_patient' as relationship from ({G5_ROWS})
  union all select Provider, AttendingPhysician, 'attended_by' from ({G5_ROWS})
  union all select Provider, OperatingPhysician, 'operated_by' from ({G5_ROWS})) where length(dst) > 0"""
FRAUD_IDS = f"select distinct Provider as id from ({G5_ROWS}) where PotentialFraud = 'Yes'"
SAMPLE = f"""select src, dst, relationship, rn, cast((rn - 1) // {SUBGRAPH_EDGES} as integer) as chunk from (
  select *, cast(row_number() over (order by md5(concat_ws('|', '{SEED}', coalesce(src, ''), coalesce(dst, ''), coalesce(relationship, ''))), src, dst, relationship) as integer) as rn
  from ({G5_E})) where rn <= {SUBGRAPH_EDGES * SUBGRAPH_COUNT}"""
SIMPLE = f"""select chunk, least(src, dst) as u, greatest(src, dst) as v, arg_max(relationship, rn) as relationship
from ({SAMPLE}) group by chunk, least(src, dst), greatest(src, dst)"""


@query("g01_bipartite_vertices", BI_V, ("G1", "U3", "U4", "P3"))
def g01_bipartite_vertices(spark, d):
    return G.bipartite_vertices(_claims(spark, d))


@query("g02_bipartite_edges", """
select BeneID as src, Provider as dst, InscClaimAmtReimbursed, ClaimStartDt, ClaimEndDt, PotentialFraud from claims_full
""", ("G2", "P15"))
def g02_bipartite_edges(spark, d):
    return G.bipartite_edges(_claims(spark, d, fx.LABEL))


@query("g03_tripartite_vertices", """
select distinct id, type from (
  select BeneID as id, 'patient' as type from claims_full
  union all select AttendingPhysician, 'doctor' from claims_full
  union all select OperatingPhysician, 'doctor' from claims_full
  union all select OtherPhysician, 'doctor' from claims_full
  union all select Provider, 'provider' from claims_full) where id is not null
""", ("G3", "U3", "U4"))
def g03_tripartite_vertices(spark, d):
    return G.tripartite_vertices(_claims(spark, d))


@query("g04_tripartite_edges", """
select * from (
  select BeneID as src, AttendingPhysician as dst, 'visited' as relationship from claims_full
  union all select BeneID, OperatingPhysician, 'visited' from claims_full
  union all select BeneID, OtherPhysician, 'visited' from claims_full
  union all select AttendingPhysician, Provider, 'affiliated_with' from claims_full
  union all select OperatingPhysician, Provider, 'affiliated_with' from claims_full
  union all select OtherPhysician, Provider, 'affiliated_with' from claims_full
  union all select BeneID, Provider, 'used_provider' from claims_full) where src is not null and dst is not null
""", ("G4", "U3", "P7"))
def g04_tripartite_edges(spark, d):
    return G.tripartite_edges(_claims(spark, d))


@query("g05_provider_edges", G5_E, ("G5", "P7", "P10"))
def g05_provider_edges(spark, d):
    return G.provider_edges(_claims(spark, d, fx.LABEL))


@query("g06_node_attributes", f"""
select n.id, f.id is not null as is_fraud,
  case when f.id is not null then 'red' else 'skyblue' end as color,
  case when f.id is not null then 800 else 300 end as size
from (select distinct id from (select src as id from ({G5_E}) union all select dst from ({G5_E}))) n
left join ({FRAUD_IDS}) f on n.id = f.id
""", ("G6", "P5"))
def g06_node_attributes(spark, d):
    c = _claims(spark, d, fx.LABEL)
    return G.node_attributes(G.provider_edges(c), G.fraud_ids(c))


@query("g07_degrees", f"""
select id, cast(count(*) as bigint) as degree from (select src as id from ({BI_E}) union all select dst from ({BI_E})) group by id
""", ("G7", "O1"))
def g07_degrees(spark, d):
    return G.degrees(G.bipartite_edges(_claims(spark, d)))


def _pagerank_sql(iters: int, reset: float) -> str:
    ctes = [
        ("v", f"select distinct id from ({BI_V}) where id is not null"),
        ("p", f"select src, dst, count(*) as m from ({BI_E}) where src is not null and dst is not null group by src, dst"),
        ("o", "select src, sum(m) as deg from p group by src"),
        ("w", "select p.src, p.dst, cast(p.m as double) / o.deg as w from p join o on p.src = o.src"),
        ("r0", "select id, 1.0::double as rank from v"),
    ]
    for i in range(1, iters + 1):
        ctes.append((f"r{i}", f"""select v.id, {reset} + {1 - reset} * coalesce(m.s, 0.0) as rank from v left join
  (select w.dst, sum(r.rank * w.w) as s from w join r{i - 1} r on w.src = r.id group by w.dst) m on v.id = m.dst"""))
    body = ",\n".join(f"{n} as ({s})" for n, s in ctes)
    return f"""with {body}
select id, round(rank * (select count(*) from r{iters}) / (select sum(rank) from r{iters}), 6) as pagerank from r{iters}"""


@query("g08_pagerank", _pagerank_sql(PAGERANK_ITERS, PAGERANK_RESET), "G8", headline=True)
def g08_pagerank(spark, d):
    c = _claims(spark, d)
    pr = G.pagerank(G.bipartite_vertices(c), G.bipartite_edges(c), PAGERANK_RESET, PAGERANK_ITERS)
    return rounded(pr, {"pagerank": 6})


def _lpa_sql(iters: int) -> str:
    ctes = [
        ("v", f"select distinct id from ({BI_V}) where id is not null"),
        ("b", f"""select v, nbr, count(*) as m from (
            select src as v, dst as nbr from ({BI_E}) where src is not null and dst is not null
            union all select dst, src from ({BI_E}) where src is not null and dst is not null) group by v, nbr"""),
        ("l0", "select id, id as label from v"),
    ]
    for i in range(1, iters + 1):
        ctes.append((f"c{i}", f"""select v, label from (
            select b.v, l.label, sum(b.m) as c from b join l{i - 1} l on b.nbr = l.id group by b.v, l.label
          ) qualify row_number() over (partition by v order by c desc, label) = 1"""))
        ctes.append((f"l{i}", f"select l.id, coalesce(c.label, l.label) as label from l{i - 1} l left join c{i} c on l.id = c.v"))
    body = ",\n".join(f"{n} as ({s})" for n, s in ctes)
    return f"with {body}\nselect id, label from l{iters}"


@query("g09_label_propagation", _lpa_sql(LPA_ITERS), "G9")
def g09_label_propagation(spark, d):
    c = _claims(spark, d)
    return G.label_propagation(G.bipartite_vertices(c), G.bipartite_edges(c), LPA_ITERS)


@query("o03_sample_chunks", SAMPLE, ("O3", "G11"))
def o03_sample_chunks(spark, d):
    s = G.sample_chunks(G.provider_edges(_claims(spark, d, fx.LABEL)), SUBGRAPH_EDGES, SUBGRAPH_COUNT, SEED)
    return s.select("src", "dst", "relationship", F.col("rn").cast("int").alias("rn"), "chunk")


@query("g10_simple_subgraphs", SIMPLE, ("G10", "G11"))
def g10_simple_subgraphs(spark, d):
    s = G.sample_chunks(G.provider_edges(_claims(spark, d, fx.LABEL)), SUBGRAPH_EDGES, SUBGRAPH_COUNT, SEED)
    return G.simple_graph(s, ["chunk"])


@query("g11_subgraph_nodes", f"""
select n.chunk, n.id, f.id is not null as is_fraud,
  case when f.id is not null then 'red' else 'skyblue' end as color,
  case when f.id is not null then 800 else 300 end as size
from (select distinct chunk, id from (select chunk, u as id from ({SIMPLE}) union all select chunk, v from ({SIMPLE}))) n
left join ({FRAUD_IDS}) f on n.id = f.id
""", ("G11", "G6", "G10"))
def g11_subgraph_nodes(spark, d):
    c = _claims(spark, d, fx.LABEL)
    _, nodes = G.sample_subgraphs(G.provider_edges(c), G.fraud_ids(c), SUBGRAPH_EDGES, SUBGRAPH_COUNT, SEED)
    return nodes
