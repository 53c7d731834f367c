"""Connected components of a link table by label propagation with pointer jumping, all in joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimscope.llm.common import written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node``, ``root`` for every node that has a link; the root is the least node of its component.

    Each round takes the least root among a node's neighbours (a partial aggregation, so a node with very many links
    is cheap), hooks the node's old root to it, and then halves the way to the roots.  Rounds go on until nothing
    changes; their number grows with the logarithm of a component's size, not with its diameter.
    """
    both = links.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x <> y")
    both = written(both.union(both.select(F.col("y").alias("x"), F.col("x").alias("y"))), "links")
    roots = written(both.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.first("x")).alias("root")), "roots")
    while True:
        near = both.join(roots, both.y == roots.node).groupBy("x").agg(F.min("root").alias("near"))
        step = roots.join(near, roots.node == near.x).select("node", "root", F.least("root", "near").alias("least"))
        # the old root of a node learns of the lesser root too
        hook = step.groupBy(F.col("root").alias("h")).agg(F.min("least").alias("hooked"))
        new = step.join(hook, step.node == hook.h, "left").select("node", "root", F.least("least", F.coalesce("hooked", "least")).alias("up"))
        up = new.select(F.col("node").alias("n2"), F.col("up").alias("up2"))
        new = new.join(up, new.up == up.n2).select("node", F.col("up2").alias("root"), (F.col("up2") != F.col("root")).alias("moved"))
        new = written(new, "roots")
        moved = new.where("moved").limit(1).count()
        roots = new.select("node", "root")
        if not moved:
            return roots
