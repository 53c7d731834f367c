"""Graph rules, metrics, splits and contributions: edge cases and properties."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimscope.operators import explain as E
from claimscope.operators import features as FE
from claimscope.operators import graph as G
from claimscope.operators import metrics as ME
from claimscope.operators import models as MO
from claimscope.operators import smote as SM


def edges_df(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


def test_degrees_count_parallel_edges(spark):
    e = edges_df(spark, [("a", "p"), ("a", "p"), ("b", "p")])
    out = {r.id: r.degree for r in G.degrees(e).collect()}
    assert out == {"a": 2, "b": 1, "p": 3}
    assert sum(out.values()) == 2 * 3


def _pagerank_reference(vertices, edges, reset=0.15, iters=10):
    out_deg = {v: 0 for v in vertices}
    for s, _ in edges:
        out_deg[s] += 1
    rank = {v: 1.0 for v in vertices}
    for _ in range(iters):
        msg = {v: 0.0 for v in vertices}
        for s, d in edges:
            msg[d] += rank[s] / out_deg[s]
        rank = {v: reset + (1 - reset) * msg[v] for v in vertices}
    total = sum(rank.values())
    return {v: r * len(vertices) / total for v, r in rank.items()}


def test_pagerank_matches_reference_loop_and_sums_to_n(spark):
    pairs = [("a", "p"), ("a", "p"), ("a", "q"), ("b", "p"), ("c", "q"), ("p", "q")]
    verts = ["a", "b", "c", "p", "q", "iso"]
    v = spark.createDataFrame([(x, "t") for x in verts], "id string, type string")
    out = {r.id: r.pagerank for r in G.pagerank(v, edges_df(spark, pairs), iters=10, checkpoint_every=3).collect()}
    ref = _pagerank_reference(verts, pairs)
    for k in verts:
        assert abs(out[k] - ref[k]) < 1e-9
    assert abs(sum(out.values()) - len(verts)) < 1e-9


def test_label_propagation_ties_to_smallest_label(spark):
    pairs = [("x", "m"), ("y", "m")]
    v = spark.createDataFrame([(i, "t") for i in ["x", "y", "m", "lonely"]], "id string, type string")
    out = {r.id: r.label for r in G.label_propagation(v, edges_df(spark, pairs), iters=1).collect()}
    assert out["m"] == "x"  # x and y tie; smallest label wins
    assert out["x"] == "m" and out["lonely"] == "lonely"


def test_hubs_are_cut_without_changing_ranks_or_labels(spark):
    rng = np.random.default_rng(4)
    pairs = [(f"v{a}", f"v{b}") for a, b in rng.integers(0, 40, (150, 2))] + [("hub", f"v{i}") for i in range(40)] + [(f"v{i}", "hub") for i in range(0, 40, 2)] + [("hub", "v1")] * 9
    verts = sorted({x for p in pairs for x in p}) + ["iso"]
    v, e = spark.createDataFrame([(x, "t") for x in verts], "id string, type string"), edges_df(spark, pairs)
    ref = _pagerank_reference(verts, pairs)
    got = {r.id: r.pagerank for r in G.pagerank(v, e, hub_edges=5).collect()}
    assert got.keys() == ref.keys() and all(abs(got[k] - ref[k]) < 1e-9 for k in ref)
    labels = [sorted(map(tuple, G.label_propagation(v, e, iters=3, hub_edges=h).collect())) for h in (5, 10**6)]
    assert labels[0] == labels[1]


def test_label_propagation_writes_its_labels_every_round(spark, monkeypatch):
    cuts, cut = [], G._cut

    def counted(df, *args):
        out = cut(df, *args)
        cuts.append(out is not df)
        return out

    monkeypatch.setattr(G, "_cut", counted)
    rng = np.random.default_rng(9)
    # both directions, edges to oneself and parallel edges
    pairs = [(f"v{a}", f"v{b}") for a, b in rng.integers(0, 12, (60, 2))] + [("v1", "v1"), ("v1", "v2"), ("v2", "v1")]
    labels = {f"v{i}": f"v{i}" for i in range(12)}
    v = spark.createDataFrame([(x, "t") for x in labels], "id string, type string")
    got = {r.id: r.label for r in G.label_propagation(v, edges_df(spark, pairs), iters=4).collect()}
    assert cuts == [True] * 4
    for _ in range(4):
        votes = {x: {} for x in labels}
        for a, b in pairs:
            for x, y in ((a, b), (b, a)):
                votes[x][labels[y]] = votes[x].get(labels[y], 0) + 1
        labels = {x: min(c, key=lambda k: (-c[k], k)) if (c := votes[x]) else labels[x] for x in labels}
    assert got == labels


def test_star_lies_in_all_partitions(spark):
    n = 50_000
    star = spark.range(n).select(F.lit("hub").alias("src"), F.col("id").cast("string").alias("dst"), F.lit(1).alias("m"))
    cut = G.HubCut(star, "src", "dst", hub_edges=500)
    sizes = [r["count"] for r in cut.heavy.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == n and len(sizes) == G._partitions(star) and max(sizes) < n / 2
    assert cut.light.count() == 0
    assert cut.sent(spark.createDataFrame([("hub", 1.0)], "id string, share double")).agg(F.sum("share")).first()[0] == n
    cut.release()


def test_tripartite_drops_null_ends(spark):
    c = spark.createDataFrame([("B1", "P1", "D1", None, None)],
                              "BeneID string, Provider string, AttendingPhysician string, OperatingPhysician string, OtherPhysician string")
    e = G.tripartite_edges(c)
    assert e.count() == 3  # visited(D1), affiliated(D1), used_provider
    v = G.tripartite_vertices(c)
    assert sorted(r.id for r in v.collect()) == ["B1", "D1", "P1"]


def test_sample_and_simple_graph(spark):
    pairs = [(f"p{i % 3}", f"b{i}", "treats_patient") for i in range(50)] + [("p0", "b1", "attended_by")]
    e = spark.createDataFrame(pairs, "src string, dst string, relationship string")
    s = G.sample_chunks(e, chunk=10, n_chunks=2, seed=42)
    assert s.count() == 20 and sorted({r.chunk for r in s.collect()}) == [0, 1]
    again = G.sample_chunks(e, chunk=10, n_chunks=2, seed=42)
    assert sorted(map(tuple, s.collect())) == sorted(map(tuple, again.collect()))
    g = G.simple_graph(spark.createDataFrame([("a", "b", "r1", 1), ("b", "a", "r2", 2)], "src string, dst string, relationship string, rn int"))
    assert [(r.u, r.v, r.relationship) for r in g.collect()] == [("a", "b", "r2")]


def _auc_bruteforce(pairs):
    pos = [s for l, s in pairs if l == 1]
    neg = [s for l, s in pairs if l == 0]
    tot = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p in pos for n in neg)
    return tot / (len(pos) * len(neg))


def test_auc_exact_with_ties(spark):
    pairs = [(1, 0.9), (0, 0.9), (1, 0.8), (0, 0.3), (1, 0.3), (0, 0.1), (1, 0.95), (0, 0.5)]
    df = spark.createDataFrame(pairs, "label int, score double")
    assert abs(ME.roc_auc(df).first().auc - _auc_bruteforce(pairs)) < 1e-12
    curve = sorted((r.fpr, r.tpr) for r in ME.roc_curve(df).collect())
    assert curve[0] == (0.0, 0.0) and curve[-1] == (1.0, 1.0)


def test_report_zero_denominator(spark):
    df = spark.createDataFrame([(1, 0), (0, 0), (1, 0)], "label int, prediction int")
    rep = {r.row: r for r in ME.classification_report(df).collect()}
    assert rep["1"].precision == 0.0 and rep["1"].recall == 0.0 and rep["1"].f1 == 0.0
    assert abs(rep["accuracy"].f1 - 1 / 3) < 1e-12
    conf = {(r.label, r.prediction): r["count"] for r in ME.confusion(df).collect()}
    assert conf == {(0, 0): 1, (0, 1): 0, (1, 0): 2, (1, 1): 0}


def test_stratified_split_exact_shares_and_partition_independence(spark):
    base = spark.range(1003).select(F.col("id").cast("string").alias("RowID"), (F.col("id") % 3 == 0).cast("int").alias("FraudLabel"))
    out = {}
    for parts in (1, 4, 17):
        s = FE.stratified_split(base.repartition(parts))
        out[parts] = sorted((r.RowID, r.is_test) for r in s.collect())
        counts = {(r.FraudLabel, r.is_test): r["count"] for r in s.groupBy("FraudLabel", "is_test").count().collect()}
        n1, n0 = 335, 668
        assert counts[(1, True)] == math.ceil(n1 * 0.2) and counts[(0, True)] == math.ceil(n0 * 0.2)
    assert out[1] == out[4] == out[17]
    folds = FE.stratified_folds(base)
    sizes = [r["count"] for r in folds.groupBy("fold", "FraudLabel").count().collect()]
    assert max(sizes) - min([s for s in sizes]) <= 134 - 66  # per class balanced within one row
    per = {(r.fold, r.FraudLabel): r["count"] for r in folds.groupBy("fold", "FraudLabel").count().collect()}
    for lbl in (0, 1):
        vals = [per[(f, lbl)] for f in range(5)]
        assert max(vals) - min(vals) <= 1


def _shapley_bruteforce(tree, x, n_features):
    """Exact Shapley values of the cover-weighted conditional expectation."""
    left, right, feat, thr, value, cover = tree

    def expect(node, known):
        if left[node] < 0:
            return value[node]
        f = feat[node]
        if f in known:
            nxt = left[node] if x[f] <= thr[node] else right[node]
            return expect(nxt, known)
        l, r = left[node], right[node]
        return (cover[l] * expect(l, known) + cover[r] * expect(r, known)) / cover[node]

    phi = np.zeros(n_features)
    feats = list(range(n_features))
    for i in feats:
        others = [f for f in feats if f != i]
        for k in range(len(others) + 1):
            for sub in itertools.combinations(others, k):
                w = math.factorial(k) * math.factorial(n_features - k - 1) / math.factorial(n_features)
                phi[i] += w * (expect(0, set(sub) | {i}) - expect(0, set(sub)))
    return phi


def test_tree_shap_equals_bruteforce_shapley():
    # depth-3 tree splitting twice on feature 0
    left = np.array([1, 3, 5, -1, -1, -1, -1])
    right = np.array([2, 4, 6, -1, -1, -1, -1])
    feat = np.array([0, 1, 0, -1, -1, -1, -1])
    thr = np.array([0.5, 0.5, 1.5, 0, 0, 0, 0])
    value = np.array([0, 0, 0, 1.0, 3.0, -2.0, 5.0])
    cover = np.array([100.0, 40.0, 60.0, 10.0, 30.0, 25.0, 35.0])
    tree = (left, right, feat, thr, value, cover)
    xs = np.array([[0.0, 0.0, 9.0], [0.0, 1.0, 0.0], [1.0, 0.0, 0.0], [2.0, 1.0, 1.0]])
    phi = np.zeros((len(xs), 3))
    E.tree_shap(xs, tree, phi)
    for row, p in zip(xs, phi):
        assert np.allclose(p, _shapley_bruteforce(tree, row, 3), atol=1e-12)


def test_tree_contributions_sum_to_margin(spark):
    df = spark.range(600).select(
        F.col("id").cast("string").alias("RowID"),
        (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 11).cast("double").alias("b"),
        (((F.col("id") % 7) + (F.col("id") % 11)) > 8).cast("int").alias("FraudLabel"),
    )
    model = MO.fit_gbt(df, ["a", "b"], rounds=5, depth=3)
    contrib, base = E.tree_contributions(model, df, ["a", "b"])
    s = contrib.groupBy("RowID").agg(F.sum("value").alias("s"))
    err = s.join(E.raw_margin(model, df, ["a", "b"]), "RowID").select(F.max(F.abs(F.col("s") + base - F.col("margin"))))
    assert err.first()[0] < 1e-9


def test_explanation_text(spark):
    c = spark.createDataFrame([("r", 1, "f1", 0.5), ("r", 1, "f2", -2.0)], "RowID string, FraudLabel int, feature string, value double")
    p = E.explanation_prompt(c).first().prompt
    assert "- f2: -2.0000\n- f1: 0.5000\n" in p
    assert p.startswith("\nYou are a healthcare fraud detection analyst. A model has flagged")
    assert p.endswith("based on these features.")


def _nearest_by_force(pts, k):
    out = {}
    for i, p in enumerate(pts):
        d = np.sqrt(((pts - p) ** 2).cumsum(axis=1)[:, -1])
        out[str(i)] = [s for _, s in sorted((d[j], str(j)) for j in range(len(pts)) if j != i)[:k]]
    return {a: b for a, b in out.items() if b}


def _points(spark, pts):
    return spark.createDataFrame([(str(i), [float(v) for v in p]) for i, p in enumerate(pts)], "k string, x array<double>")


@pytest.mark.parametrize("case", ["scaled", "mostly one point", "one", "all equal"])
def test_exact_knn_matches_bruteforce(spark, case):
    rng = np.random.default_rng(7)
    if case == "scaled":
        pts = rng.normal(size=(300, 4)) * np.array([50.0, 1.0, 3.0, 0.2])
        pts[10] = pts[11]  # a duplicate pair
    elif case == "mostly one point":  # and a grid of equal distances around it
        pts = np.zeros((200, 3))
        pts[100:] = rng.integers(0, 4, size=(100, 3))
        pts[:20] = rng.normal(size=(20, 3))
        pts[5] = 1e6
    else:
        pts = {"one": np.zeros((1, 2)), "all equal": np.zeros((9, 2))}[case]
    got = {}
    for r in SM.nearest_neighbors(_points(spark, pts), "k", 5, leaf_size=8).collect():
        got.setdefault(r.k, []).append((r.nn, r.nbr))
    assert {a: [n for _, n in sorted(b)] for a, b in got.items()} == _nearest_by_force(pts, 5)


def test_knn_leaves_are_bounded_and_candidates_do_not_follow_the_rows(spark):
    rng = np.random.default_rng(11)
    per_point = {}
    for n in (1000, 4000):
        pts = rng.uniform(size=(n, 3))
        pts[rng.uniform(size=n) < 0.5] = 0.5  # half of the rows are one point
        locs = SM.locations(_points(spark, pts), "k", 5)
        rows, parts = SM.split_tree(locs, 5, leaf_size=16)
        assert parts.where("leaf").agg(F.max("n")).first()[0] <= 16
        assert rows.agg(F.sum("w")).first()[0] == n and rows.count() == locs.count()
        # the true 6th distance plus some slack as the bound of every location
        uniq = {r.loc: np.array(r.x) for r in locs.select("loc", "x").collect()}
        xs = np.array(list(uniq.values()))
        kth = {a: float(np.sort(np.sqrt(((xs - x) ** 2).sum(axis=1)))[min(6, len(xs) - 1)]) for a, x in uniq.items()}
        bounds = spark.createDataFrame(list(kth.items()), "q string, bound double")
        queries = rows.select(F.col("loc").alias("q"), F.col("x").alias("qx"), F.col("node").alias("home")).join(bounds, "q")
        hits = SM.leaf_hits(queries, parts, 5).join(parts.where("leaf").select("node", "n"), "node")
        per_point[n] = hits.agg(F.sum("n")).first()[0] / len(uniq)
    assert per_point[4000] < 1.5 * per_point[1000] and per_point[4000] < 4000 / 8


def test_smote_balances_inside_minority_box(spark):
    from claimscope.operators.smote import smote

    rng = np.random.default_rng(3)
    data = [(f"a{i}", float(x), float(y), 0) for i, (x, y) in enumerate(rng.normal(size=(20, 2)))]
    data += [(f"b{i}", float(x) + 5, float(y) * 2, 1) for i, (x, y) in enumerate(rng.normal(size=(6, 2)))]
    df = spark.createDataFrame(data, "RowID string, f1 double, f2 double, FraudLabel int")
    out = smote(df, ["f1", "f2"], k=5)
    counts = {r.FraudLabel: r["count"] for r in out.groupBy("FraudLabel").count().collect()}
    assert counts == {0: 20, 1: 20}
    assert out.where("synthetic").count() == 14
    mn = [min(r[i] for r in data if r[3] == 1) for i in (1, 2)]
    mx = [max(r[i] for r in data if r[3] == 1) for i in (1, 2)]
    for r in out.where("synthetic").collect():
        assert mn[0] - 1e-9 <= r.f1 <= mx[0] + 1e-9 and mn[1] - 1e-9 <= r.f2 <= mx[1] + 1e-9
    again = smote(df, ["f1", "f2"], k=5).where("synthetic")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, out.where("synthetic").collect()))
