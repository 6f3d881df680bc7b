"""Connected components of a graph given as pairs of numbers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiltframe.llm.common import cut

#: Edges that the driver solves by itself (16 bytes each); larger graphs stay distributed. Both give the same result.
DRIVER_EDGES = 4_000_000


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges a-b and the smallest node that each can reach."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while len(x):
        low = np.minimum(root[x], root[y])
        before = root.copy()
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        while (root[root] != root).any():
            root = root[root]
        if (root == before).all():
            break
        open_ = root[x] != root[y]
        x, y = x[open_], y[open_]
    return nodes, nodes[root]


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node within reach) for each node of edges (a, b: long).

    Alternating large-star and small-star steps, each a group-by whose groups
    are spread by their edges: the edges of a node are never held together, as
    only its minimum is needed, which is combined before the shuffle. Loops and
    repeated edges do no harm; no edges give no rows.
    """
    spark = edges.sparkSession
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    n = edges.count()
    if n <= DRIVER_EDGES:
        t = edges.toArrow()
        nodes, root = roots(t["a"].to_numpy(), t["b"].to_numpy())
        import pandas as pd

        return spark.createDataFrame(pd.DataFrame({"node": nodes.astype("i8"), "root": root.astype("i8")}), "node long, root long")
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))  # larger neighbours to the least
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        after = cut(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        # done once every node has one edge, to a root, and no root has one of its own
        ends = after.select("b").distinct()
        if after.groupBy("a").count().where("count > 1").isEmpty() and after.join(ends.select(F.col("b").alias("a")), "a", "left_semi").isEmpty():
            break
        edges = after
    return after.select(F.col("a").alias("node"), F.col("b").alias("root")).union(after.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
