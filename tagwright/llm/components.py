"""Connected components of an edge table, without bringing edges to the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: A graph of at most this many edges (16 bytes each) is finished by one task; a larger one is contracted first.
ONE_TASK_EDGES = 400_000


def _union_find(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    parts = [f[["a", "b"]].to_numpy(np.int64) for f in frames]
    edges = np.concatenate(parts) if parts else np.empty((0, 2), np.int64)
    nodes, ends = np.unique(edges, return_inverse=True)
    parent = list(range(len(nodes)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in ends.reshape(-1, 2).tolist():
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    root = np.array([find(i) for i in range(len(nodes))], np.int64)
    yield pd.DataFrame({"node": nodes, "root": nodes[root] if len(nodes) else nodes})


def components(edges: DataFrame, one_task_edges: int = ONE_TASK_EDGES) -> DataFrame:
    """edges: columns a and b, both long. One row (node, root) for each node of an edge; root is the same within a component.

    While the graph is larger than one task may hold, each node is joined to its least neighbour (a minimum, combined before the
    shuffle), twice over, and the edges are rewritten between the nodes so reached; at least every second node with an edge goes
    each time. An empty edge table gives an empty result; loops and repeated edges do no harm.
    """
    edges = cut(edges.select("a", "b").filter("a <> b").distinct())
    steps = []
    while edges.count() > one_task_edges:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("up")))
        again = least.select(F.col("node").alias("up"), F.col("up").alias("root"))
        step = cut(least.join(again, "up", "left").select("node", F.coalesce("root", "up").alias("root")))
        steps.append(step)
        of = {k: step.select(F.col("node").alias(k), F.col("root").alias(f"r{k}")) for k in "ab"}
        edges = cut(edges.join(of["a"], "a").join(of["b"], "b").select(F.col("ra").alias("a"), F.col("rb").alias("b")).filter("a <> b").distinct())
    found = cut(edges.coalesce(1).mapInPandas(_union_find, "node long, root long"))
    for step in reversed(steps):
        later = found.select(F.col("node").alias("root"), F.col("root").alias("final"))
        found = cut(step.join(later, "root", "left").select("node", F.coalesce("final", "root").alias("root")))
    return found
