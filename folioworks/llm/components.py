"""Connected components of an edge table, as joins and aggregates."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from folioworks.session import staged


def local_roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest member of each of 0..n-1's component, for the edges inside one group."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[left], root[right])
        new = root.copy()
        np.minimum.at(new, root[left], low)
        np.minimum.at(new, root[right], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``edges`` (u, v: longs) to (node, root): root is the smallest node reachable.

    Rounds of large stars and small stars: each node hands its neighbours to the least
    one among them, so that every component ends as one star around its least node.
    Neighbourhoods are only ever reduced to a minimum (summed up before the shuffle)
    and joined back (a join whose hot side Spark may split), never collected. Rounds
    grow with the logarithm of the longest chain. Nodes without edges, null ends and
    loops give no row; repeated edges count once. An empty table gives no rows.
    """
    clean = edges.where("u is not null and v is not null and u <> v")
    stars = staged(clean.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    for _ in range(most_rounds):
        both = stars.union(stars.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        after = staged(small.where("u <> v").distinct(), "edges")
        # A star forest: no node hangs on two others, and no centre hangs on another node.
        hung = after.groupBy("u").agg(F.count("*").alias("n"))
        bent = hung.where("n > 1").select("u").union(after.join(hung.select(F.col("u").alias("v")), "v", "left_semi").select("v"))
        stars = after
        if bent.isEmpty():
            break
    else:
        raise RuntimeError(f"components not settled after {most_rounds} rounds")
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).union(stars.select("v", "v").distinct())
