"""Near-duplicate vectors against all pairs; recall of the graph by itself."""

import math
import random

import numpy as np
import pandas as pd
import pytest

from tagwright.llm import op13_robust_graph as G
from tagwright.llm.robust_graph import RobustGraph

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, least=0.98):
    """Counts and components by all pairs of usable vectors of one label."""
    good = {i: (lab, np.array(v, np.float64)) for i, v, lab in rows if i is not None and v and lab is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    ids = sorted(good)
    near = {i: {j for j in ids if j != i and good[i][0] == good[j][0] and len(good[i][1]) == len(good[j][1])
                and good[i][1] @ good[j][1] / (np.linalg.norm(good[i][1]) * np.linalg.norm(good[j][1])) >= least - 1e-12} for i in ids}
    out = {}
    for i in sorted({r[0] for r in rows if r[0] is not None}):
        seen, todo = {i}, [i]
        while todo:
            new = near.get(todo.pop(), set()) - seen
            seen |= new
            todo += new
        out[i] = (len(near.get(i, ())), min(seen), min(seen) == i)
    return out


def clustered(rng, n, centres, dim=12, spread=0.35, first=0):
    c = rng.normal(size=(centres, dim))
    x = c[rng.integers(0, centres, n)] + spread * rng.normal(size=(n, dim))
    near = x[rng.integers(0, n, n // 3)]
    x = np.concatenate([x, near + 0.03 * rng.normal(size=near.shape), np.repeat(x[:3], 20, 0)])
    return [(first + i, [float(np.float32(y)) for y in v], int(k)) for i, (v, k) in enumerate(zip(x, rng.integers(0, 3, len(x)), strict=True))]


def result(frame, **more):
    return {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in G.near_duplicates(frame, **more).collect()}


@pytest.mark.parametrize("capacity", [4096, 60])
def test_against_all_pairs(spark, capacity):
    """Once in one shard for each label, once split into overlapping shards and chunks."""
    rng = np.random.default_rng(4)
    rows = clustered(rng, 300, 9)
    ball = rng.normal(size=12)
    rows += [(10_000 + i, [float(np.float32(y)) for y in ball + 0.02 * rng.normal(size=12)], 1) for i in range(150)]
    got, want = result(spark.createDataFrame(rows, SCHEMA).repartition(4), capacity=capacity), plain(rows)
    assert set(got) == set(want)
    assert sum(v[0] for v in got.values()) >= 0.99 * sum(v[0] for v in want.values())
    assert all(got[i][0] <= want[i][0] for i in want)  # nothing below the threshold
    assert sum(got[i] == want[i] for i in want) >= 0.98 * len(want)


def test_shards_lose_no_link(spark):
    rng = np.random.default_rng(5)
    rows = [(i, v) for i, v, _ in clustered(rng, 900, 30, dim=6, spread=0.15)]
    nodes = spark.createDataFrame([("a", i, v) for i, v in rows], "shard string, id long, v array<double>")
    shards = {}
    for r in G.shards(nodes, capacity=200).collect():
        shards.setdefault(r["id"], set()).add(r["shard"])
    assert len(shards) == len(rows) and len({s for x in shards.values() for s in x}) > 3
    x = G.unit(pd.Series([v for _, v in rows]))
    for i, j in zip(*np.nonzero(np.triu(x @ x.T >= 0.98, 1)), strict=True):
        assert shards[rows[i][0]] & shards[rows[j][0]]


def test_recall_of_the_graph_alone(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(1500, 32))
    x[300:600] = x[:300] + 0.02 * rng.normal(size=(300, 32))
    x[600:800] = x[0] + 0.05 * rng.normal(size=(200, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    true = x @ x.T >= 0.98
    np.fill_diagonal(true, False)
    graph = RobustGraph.built(x.astype(np.float32))
    found = G._found(graph, x, np.arange(len(x)), 0.98, 0.95, 16)
    assert not (found & ~true).any() and (found & true).sum() >= 0.995 * true.sum()
    assert (graph.links >= 0).sum(1).max() <= graph.links.shape[1] and (graph.links != np.arange(1500)[:, None]).all()
    rows = spark.createDataFrame([(i, [float(y) for y in v], 1) for i, v in enumerate(x)], SCHEMA)
    tested, hit = G.recall(rows)
    assert tested and hit >= 0.99 * tested


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.01], 1), (4, [1.0, 0.0], 2), (5, [1.0, 0.0], None), (6, None, 1), (7, [], 1), (8, [0.0, 0.0], 1), (9, [nan, 1.0], 1),
        (10, [inf, 1.0], 1), (11, [None, 1.0], 1), (12, [1.0, 0.0, 0.0], 1), (13, [1.0, 0.0], 2), (13, [1.0, 0.0], 2), (14, [1e-38, 0.0], 1), (15, [-1.0, 0.0], 1), (16, [3e38, 0.0], 1), (17, None, None), (17, [0.0, 1.0], 3),
    ]
    got = result(spark.createDataFrame(rows, SCHEMA))
    assert got == plain([r for r in rows if r != (17, None, None)])
    assert got[1] == (4, 1, True) and got[16] == (4, 1, False) and got[13] == (1, 4, False) and got[17] == (0, 17, True)
    unnamed = spark.createDataFrame([*rows, (None, [1.0, 0.0], 1), (None, None, None)], SCHEMA)
    assert sorted((tuple(r) for r in G.near_duplicates(unnamed).collect() if r["vec_id"] is None), key=repr) == [(None, 0, None, True)] * 2


def test_empty_table_and_clashing_names(spark):
    assert G.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
    random.seed(1)
    rows = [(i, [random.random(), random.random()], 1, "s", 2, 3) for i in range(30)]
    wide = spark.createDataFrame(rows, SCHEMA + ", shard string, id int, v int")
    assert result(wide) == plain([r[:3] for r in rows])
