"""Per-row feature contributions and explanation text.

* Linear model: contribution_j = coef_j * (x_j - mean_j) over the training
  means - plain column expressions, exact.
* Tree ensembles: path-dependent TreeSHAP (Lundberg, Erion & Lee, 2018).
  The fitted model is written to the shared checkpoint folder and its node
  table is read back as a DataFrame (model-sized, collected once); each task
  then evaluates the trees on its Arrow batches with numpy, vectorised over
  the rows of the batch (``mapInPandas``).  A leaf's share in a row depends
  only on which decisions on its path the row follows, so for trees of a
  usual depth the shares are worked out once per leaf and looked up.  Contributions plus the expected
  value give the model's raw margin exactly.
* Explanation text: the long contribution table is cut to the top 10 per row
  by |value| (``row_number`` with a limit: at most 10 rows per group leave a
  task) and folded into one text per row.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimscope.functions.values import (
    EXPLAIN_CLOSE_FRAUD,
    EXPLAIN_CLOSE_OK,
    EXPLAIN_HEADER,
    EXPLAIN_LINE_FORMAT,
    EXPLAIN_OPEN_FRAUD,
    EXPLAIN_OPEN_OK,
    EXPLAIN_ROLE,
    EXPLAIN_TOP_K,
)
from claimscope.operators.windows import top_k_per_group
from claimscope.session import ensure_checkpoint_dir

#: Bytes of a model's leaf tables beyond which rows are worked out one by one.
TABLE_BYTES = 64 << 20


def _long(df: DataFrame, key: str, values: dict, keep: Sequence[str] = ()) -> DataFrame:
    entries = [F.struct(F.lit(name).alias("feature"), expr.cast("double").alias("value")) for name, expr in values.items()]
    return df.select(key, *keep, F.inline(F.array(*entries)))


# M14 (linear)
def linear_contributions(model, train: DataFrame, df: DataFrame, features: Sequence[str], key: str = "RowID",
                         keep: Sequence[str] = ()) -> tuple[DataFrame, float]:
    """Long table (key, feature, value) and the base value
    (intercept + sum coef * mean).  Base + row sum = the row's margin."""
    coefs = [float(c) for c in model.coefficients.toArray()]
    means_row = train.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in features]).first()
    means = [float(means_row[c]) for c in features]
    base = float(model.intercept) + sum(c * m for c, m in zip(coefs, means))
    vals = {f: F.lit(c) * (F.col(f).cast("double") - F.lit(m)) for f, c, m in zip(features, coefs, means)}
    return _long(df, key, vals, keep), base


# ------------------------------------------------------------ trees
def tree_tables(model) -> tuple[list[tuple[np.ndarray, ...]], list[float]]:
    """Node arrays per tree (left, right, feature, threshold, value, cover)
    and the tree weights, read from the model's saved node table.

    Boosted trees: value = leaf prediction (margin units), cover = training
    count, weights = the ensemble's tree weights.  Random forest: value =
    share of class 1 in the leaf, cover = leaf count, weight 1 / trees (the
    forest averages the trees' class distributions)."""
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    forest = type(model).__name__.startswith("RandomForest")
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/models/{uuid.uuid4().hex}"
    model.write().overwrite().save(path)
    nodes = spark.read.parquet(f"{path}/data")
    if "treeID" not in nodes.columns:
        nodes = nodes.withColumn("treeID", F.lit(0))
    stats = F.col("nodeData.impurityStats")
    if forest:
        cover = F.aggregate(stats, F.lit(0.0), lambda a, b: a + b)
        value = F.when(cover > 0, F.coalesce(F.get(stats, 1), F.lit(0.0)) / cover).otherwise(F.lit(0.0))
    else:
        cover = F.get(stats, 0)
        value = F.col("nodeData.prediction")
    rows = nodes.select(
        "treeID", "nodeData.id", "nodeData.leftChild", "nodeData.rightChild", "nodeData.split.featureIndex",
        F.get(F.col("nodeData.split.leftCategoriesOrThreshold"), 0).alias("thr"), value.alias("prediction"), cover.alias("cover"),
    ).orderBy("treeID", "id").toPandas()
    trees = []
    for _, t in rows.groupby("treeID", sort=True):
        n = int(t["id"].max()) + 1
        arr = {k: np.zeros(n) for k in ("thr", "prediction", "cover")}
        left = np.full(n, -1, dtype=np.int64)
        right = np.full(n, -1, dtype=np.int64)
        feat = np.full(n, -1, dtype=np.int64)
        ids = t["id"].to_numpy()
        left[ids] = t["leftChild"].to_numpy()
        right[ids] = t["rightChild"].to_numpy()
        feat[ids] = t["featureIndex"].to_numpy()
        for k in arr:
            arr[k][ids] = t[k].fillna(0.0).to_numpy()
        trees.append((left, right, feat, arr["thr"], arr["prediction"], arr["cover"]))
    if forest:
        weights = [1.0 / len(trees)] * len(trees)
    else:
        weights = [float(w) for w in model.treeWeights]
    return trees, weights


def expected_value(tree) -> float:
    left, right, _, _, value, cover = tree
    leaves = left < 0
    return float((value[leaves] * cover[leaves]).sum() / cover[0])


def _extend(d, z, o, w, pz, po, pi, n):
    l = len(d)
    d, z, o = d + [pi], z + [pz], o + [po]
    w = [x.copy() for x in w] + [np.full(n, 1.0 if l == 0 else 0.0)]
    for i in range(l - 1, -1, -1):
        w[i + 1] = w[i + 1] + po * w[i] * (i + 1) / (l + 1)
        w[i] = pz * w[i] * (l - i) / (l + 1)
    return d, z, o, w


def _unwind(d, z, o, w, k):
    last = len(d) - 1
    of, zf = o[k], z[k]
    nz = of != 0
    of_safe = np.where(nz, of, 1.0)
    nxt = w[last].copy()
    w = [x.copy() for x in w]
    for i in range(last - 1, -1, -1):
        tmp = w[i]
        a_w = nxt * (last + 1) / ((i + 1) * of_safe)
        a_next = tmp - a_w * zf * (last - i) / (last + 1)
        b_w = tmp * (last + 1) / (zf * (last - i)) if zf != 0 else tmp
        w[i] = np.where(nz, a_w, b_w)
        nxt = np.where(nz, a_next, nxt)
    return d[:k] + d[k + 1:], z[:k] + z[k + 1:], o[:k] + o[k + 1:], w[:last]


def _unwound_sum(z, o, w, k):
    last = len(w) - 1
    of, zf = o[k], z[k]
    nz = of != 0
    of_safe = np.where(nz, of, 1.0)
    nxt = w[last]
    total_a = np.zeros_like(nxt)
    total_b = np.zeros_like(nxt)
    for i in range(last - 1, -1, -1):
        tmp = nxt / ((i + 1) * of_safe)
        total_a = total_a + tmp
        nxt = w[i] - tmp * zf * (last - i)
        if zf != 0:
            total_b = total_b + w[i] / (zf * (last - i))
    return np.where(nz, total_a, total_b) * (last + 1)


def tree_shap(x: np.ndarray, tree, phi: np.ndarray, scale: float = 1.0) -> None:
    """Add the TreeSHAP values of one tree for all rows of ``x`` to ``phi``."""
    left, right, feat, thr, value, cover = tree
    n = x.shape[0]

    def rec(node, d, z, o, w, pz, po, pi):
        d, z, o, w = _extend(d, z, o, w, pz, po, pi, n)
        if left[node] < 0:
            for i in range(1, len(d)):
                ws = _unwound_sum(z, o, w, i)
                phi[:, d[i]] += scale * ws * (o[i] - z[i]) * value[node]
            return
        f = int(feat[node])
        go_left = (x[:, f] <= thr[node]).astype(np.float64)
        iz, io = 1.0, np.ones(n)
        if f in d:
            k = d.index(f)
            iz, io = z[k], o[k]
            d, z, o, w = _unwind(d, z, o, w, k)
        lc, rc = int(left[node]), int(right[node])
        rec(lc, d, z, o, w, iz * cover[lc] / cover[node], io * go_left, f)
        rec(rc, d, z, o, w, iz * cover[rc] / cover[node], io * (1.0 - go_left), f)

    with np.errstate(divide="ignore", invalid="ignore"):
        rec(0, [], [], [], [], 1.0, np.ones(n), -1)


def leaf_tables(tree, scale: float = 1.0, room: float = TABLE_BYTES) -> dict[int, list[tuple[int, np.ndarray]]] | None:
    """Per leaf, (feature, values): what the leaf adds to the feature's value
    for each of the 2 ** depth ways a row can agree with the decisions on the
    leaf's path (the root's is the highest bit).  Worked out once by the same
    recursion as ``tree_shap``.  None if the tables would take over ``room`` bytes."""
    left, right, feat, _, value, cover = tree
    found: dict[int, list[tuple[int, np.ndarray]]] = {}
    size = 0
    stack = [(0, [])]
    while stack:
        node, steps = stack.pop()
        if left[node] >= 0:
            for child in (int(right[node]), int(left[node])):
                stack.append((child, [*steps, (int(feat[node]), cover[child], cover[node])]))
            continue
        n = 1 << len(steps)
        size += 8 * n * len(steps)
        if size > room:
            return None
        ways = np.arange(n)
        d, z, o, w = _extend([], [], [], [], 1.0, np.ones(n), -1, n)
        for j, (f, part, whole) in enumerate(steps):
            iz, io = 1.0, np.ones(n)
            if f in d:
                k = d.index(f)
                iz, io = z[k], o[k]
                d, z, o, w = _unwind(d, z, o, w, k)
            follows = ((ways >> (len(steps) - 1 - j)) & 1).astype(np.float64)
            d, z, o, w = _extend(d, z, o, w, iz * part / whole, io * follows, f, n)
        found[node] = [(d[i], scale * _unwound_sum(z, o, w, i) * (o[i] - z[i]) * value[node]) for i in range(1, len(d))]
    return found


def tree_shap_by_table(x: np.ndarray, tree, leaves: dict, phi: np.ndarray) -> None:
    """``tree_shap`` by looking up each leaf's values; ``phi`` has one row a feature."""
    left, right, feat, thr, _, _ = tree

    def rec(node, way):
        if left[node] < 0:
            for f, values in leaves[node]:
                phi[f] += values[way]
            return
        go_left = (x[:, int(feat[node])] <= thr[node]).astype(np.intp)
        rec(int(left[node]), 2 * way + go_left)
        rec(int(right[node]), 2 * way + 1 - go_left)

    rec(0, np.zeros(len(x), dtype=np.intp))


def tree_contributions(model, df: DataFrame, features: Sequence[str], key: str = "RowID",
                       keep: Sequence[str] = ()) -> tuple[DataFrame, float]:
    """Long table (key, keep..., feature, value) of TreeSHAP values in the
    model's raw margin units, and the base value (expected margin)."""
    trees, weights = tree_tables(model)
    base = float(sum(wt * expected_value(t) for t, wt in zip(trees, weights)))
    feats = list(features)
    with np.errstate(divide="ignore", invalid="ignore"):
        tables = [leaf_tables(t, wt, TABLE_BYTES / len(trees)) for t, wt in zip(trees, weights)]

    def part(batches):
        for pdf in batches:
            x = np.asfortranarray(pdf[feats].to_numpy(dtype=np.float64))
            by_feature = np.zeros((len(feats), len(pdf)))
            phi = by_feature.T
            for t, wt, leaves in zip(trees, weights, tables):
                if leaves is None:
                    tree_shap(x, t, phi, wt)
                else:
                    tree_shap_by_table(x, t, leaves, by_feature)
            cols = {c: np.repeat(pdf[c].to_numpy(), len(feats)) for c in [key, *keep]}
            cols["feature"] = np.tile(np.array(feats, dtype=object), len(pdf))
            cols["value"] = phi.reshape(-1)
            yield pd.DataFrame(cols)

    schema = T.StructType(
        [T.StructField(c, df.schema[c].dataType) for c in [key, *keep]]
        + [T.StructField("feature", T.StringType()), T.StructField("value", T.DoubleType())]
    )
    src = df.select(key, *keep, *[F.col(c).cast("double").alias(c) for c in feats if c not in keep])
    return src.mapInPandas(part, schema), base


def raw_margin(model, df: DataFrame, features: Sequence[str], key: str = "RowID") -> DataFrame:
    """The model's raw margin per row (for checking base + sum = margin)."""
    from pyspark.ml.functions import vector_to_array

    from claimscope.operators.models import assemble

    out = model.transform(assemble(df, features))
    return out.select(key, vector_to_array("rawPrediction")[1].alias("margin"))


def mean_abs_contribution(contrib: DataFrame, k: int = 10) -> DataFrame:
    """Global importance: mean |contribution| per feature, top k."""
    agg = contrib.groupBy("feature").agg(F.avg(F.abs("value")).alias("mean_abs"))
    return agg.orderBy(F.desc("mean_abs"), "feature").limit(k)


# M15
def explanation_prompt(contrib: DataFrame, key: str = "RowID", label: str = "FraudLabel",
                       k: int = EXPLAIN_TOP_K) -> DataFrame:
    """(key, label, prompt) from a long contribution table that carries the
    label: the top-k contributions by |value| (ties by feature name) as
    '- name: 0.0000' lines between an opening and a closing that depend on
    the label (1 = flagged)."""
    order = [F.desc(F.abs("value")), F.asc("feature")]
    top = top_k_per_group(contrib, [key], order, k)
    ranked = top.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    line = F.format_string(EXPLAIN_LINE_FORMAT, F.col("feature"), F.col("value"))
    lines = ranked.groupBy(key, label).agg(F.sort_array(F.collect_list(F.struct("_r", line.alias("l")))).alias("_ls"))
    body = F.concat_ws("", F.transform("_ls", lambda s: F.concat(s["l"], F.lit("\n"))))
    flagged = F.col(label) == 1
    opening = F.when(flagged, F.lit(EXPLAIN_OPEN_FRAUD)).otherwise(F.lit(EXPLAIN_OPEN_OK))
    closing = F.when(flagged, F.lit(EXPLAIN_CLOSE_FRAUD)).otherwise(F.lit(EXPLAIN_CLOSE_OK))
    prompt = F.concat(
        F.lit("\n" + EXPLAIN_ROLE + " "), opening, F.lit("\n\n" + EXPLAIN_HEADER + "\n"), body, F.lit("\n"), closing
    )
    return lines.select(key, F.col(label).cast("int").alias(label), prompt.alias("prompt"))
