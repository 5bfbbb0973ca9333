"""Connected components: of few edges in one task, of more by alternating star
steps in tables of edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, remove

MAX_ROUNDS = 60
#: Edges that one task solves (16 bytes each); more take star steps.
FEW_EDGES = 1 << 18


#: Nodes with at least 1/HOT_SHARE of all edge ends are joined by broadcast: there are so many at most.
HOT_SHARE = 1000


def _stars(edges: DataFrame, large: bool, ends: int) -> DataFrame:
    """One star step: each node u links its neighbours (larger ones in a large
    step; smaller ones and itself in a small one) to the smallest of its
    neighbourhood. Minima are summed up before the shuffle; hubs, which would
    make large tasks of the join back, are broadcast. ``ends``: at most so many
    edge ends there are."""
    near = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    if large:
        near = edges.select("a", "b").unionByName(near)
    least = near.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).select("a", F.least("a", "m").alias("m"), "n")
    least = materialize(least, "star-minima")
    hot = F.col("n") * HOT_SHARE >= max(ends, HOT_SHARE)
    hubs = least.where(hot).select("a", "m")
    known = near.join(F.broadcast(hubs), "a", "left")
    rest = known.where("m IS NULL").select("a", "b").join(least.where(~hot).select("a", "m"), "a")
    joined = known.where("m IS NOT NULL").unionByName(rest)
    if large:
        out = joined.where("b > a").select(F.col("m").alias("a"), "b")
    else:
        own = least.where("a > m").select(F.col("m").alias("a"), F.col("a").alias("b"))
        out = joined.where("b > m").select(F.col("m").alias("a"), "b").unionByName(own)
    out = materialize(out.where("a < b").distinct(), "stars")
    remove(least)
    return out


def _solved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(node, root) of all the edges, by hooking roots to smaller ones."""
    edges = pd.concat([pd.DataFrame({"a": [], "b": []}, dtype="int64"), *batches])
    nodes, at = np.unique(edges.to_numpy().T.ravel(), return_inverse=True)
    x, y = at[: len(edges)], at[len(edges) :]
    root = np.arange(len(nodes))
    while len(x):
        low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]
        apart = root[x] != root[y]
        x, y = x[apart], y[apart]
    yield pd.DataFrame({"node": nodes, "root": nodes[root]})


def smallest_reachable(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (long columns a < b): root is
    the smallest node of its component. FEW_EDGES are solved by one task. More
    take O(log n) rounds or so; each is written to the shared folder, so no
    lineage builds up, and tables of the round before are removed."""
    current = edges.select("a", "b")
    n, before = current.count(), None
    if n <= FEW_EDGES:
        return current.coalesce(1).mapInPandas(_solved, "node long, root long")
    for _ in range(MAX_ROUNDS):
        middle = _stars(current, True, 2 * n)
        after = _stars(middle, False, max(n, 1))
        if before:
            remove(current)
        remove(middle)
        current = after
        # Stars only: nobody is both a root and a leaf, and each leaf has one root.
        now = current.agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")
        ).first()
        n = now["n"]
        if (now["n"], now["h"]) == before:
            break
        before = (now["n"], now["h"])
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return current.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(
        current.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
    )
