"""Near-duplicate vectors of a label: links at a cosine of 0.98 or more, found in a robust-pruned flat graph.

Equal vectors of a label are one class; its smallest id stands for all. Classes are cut into overlapping shards: a shard with more than
``CAPACITY`` vectors is split by centroids fitted on a bounded sample of it, and each vector goes into the shard of every centroid whose
angle is at most the links' angle more than that of its nearest one. By the triangle inequality two vectors of a link then share a shard:
the one that is nearer to its own centroid shares that with the other. Shards are split again until they fit. A shard that splitting
would not make cheaper (one dense ball, or vectors without structure) is cut into chunks instead, and each two chunks meet in a task.

Each chunk builds its graph. The lists of neighbours that a vector gets in several shards become one. In every shard all its vectors are
searched for from the chunks' medoids, first greedily, then on from every vector within a wider range, itself included, until nothing new is in range. A
sample of each task's vectors is compared with all by brute force; where less than ``AUDIT`` of their links were found, the task searches
again with a beam twice as wide. Cosines near the threshold are verified in double precision. A pair that shares several shards
counts in the first alone. A task emits counts and a spanning forest of its links, never the pairs, so a dense group costs rows in
proportion to its vectors; the time of a dense group of different vectors is that of its pairs.

Vectors that are null, zero, or hold null or non-finite components link with nothing, nor do those without a label or of different
length. Rows of one vec_id are one vector: the first valid one by label and vector. A row with a null vec_id has no links, a null component,
and is kept. Other columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut
from .components import components
from .robust_graph import BEAM, RobustGraph, medoid

LEAST, REACH = 0.98, 0.95
#: Vectors to a task; vectors that centroids are fitted on, centroids to a split, and vectors to a task of a split.
CAPACITY, SAMPLE, CENTROIDS, PIECE = 8192, 8192, 32, 20_000
#: A split is taken if it leaves less than this of the pairs.
WORTH = 0.7
#: Vectors audited in a task, and the share of their links that must be found.
AUDITED, AUDIT = 48, 0.99
#: More than what single precision may be wrong by.
SLACK = 1e-4


def _usable(v: Column) -> Column:
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))


def unit(vectors: pd.Series) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in vectors])
    x = x / np.abs(x).max(1, keepdims=True)  # squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _centroids(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        own = (x @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        length = np.sqrt((sums * sums).sum(1, keepdims=True))
        c = np.where(length > 0, sums / np.maximum(length, 1e-300), c)
    return c


def _members(x: np.ndarray, c: np.ndarray, least: float) -> np.ndarray:
    """Which centroids' shards each vector belongs to."""
    angle = np.arccos(np.clip(x @ c.T, -1, 1))
    return angle <= angle.min(1, keepdims=True) + np.arccos(least) + 1e-9


def shards(nodes: DataFrame, least: float = LEAST, capacity: int = CAPACITY) -> DataFrame:
    """nodes: shard, id, v. The same columns, with smaller shards that overlap; any two vectors linked share one."""
    done, kind = [], nodes.schema["v"].dataType.simpleString()
    while True:
        sizes = cut(nodes.groupBy("shard").agg(F.count("*").alias("n")))
        large = sizes.filter(F.col("n") > capacity)
        if large.isEmpty():
            return _all([*done, nodes])
        done.append(nodes.join(large.select("shard"), "shard", "left_anti"))
        split = nodes.join(large, "shard")
        share = F.pmod(F.xxhash64("id", F.lit(13)), F.lit(1 << 30)) < F.lit(SAMPLE) / F.col("n") * (1 << 30)

        def fit(rows: pd.DataFrame) -> pd.DataFrame:
            k = int(min(CENTROIDS, max(2, -(-int(rows["n"].iloc[0]) * 2 // capacity)), len(rows)))
            c = _centroids(unit(rows.sort_values("id")["v"]), k)
            return pd.DataFrame({"shard": rows["shard"].iloc[0], "n": rows["n"].iloc[0], "child": range(len(c)), "c": list(c)})

        centroids = cut(split.filter(share).groupBy("shard").applyInPandas(fit, "shard string, n long, child int, c array<double>"))
        pieces = F.ceil(F.col("n") / PIECE).cast("int")
        left = split.withColumn("piece", F.pmod(F.xxhash64("id"), pieces).cast("int"))
        right = centroids.withColumn("piece", F.explode(F.sequence(F.lit(0), pieces - 1))).select("shard", "piece", "child", "c").toDF("shard", "piece", "child", "c")

        def place(rows: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
            if not len(rows) or not len(given):
                return rows.assign(child=-1)[["shard", "n", "child", "id", "v"]]
            given = given.sort_values("child")
            at, to = np.nonzero(_members(unit(rows["v"]), unit(given["c"]), least))
            return rows.iloc[at].assign(child=given["child"].to_numpy()[to])[["shard", "n", "child", "id", "v"]]

        placed = cut(left.groupBy("shard", "piece").cogroup(right.groupBy("shard", "piece")).applyInPandas(place, f"shard string, n long, child int, id long, v {kind}"))
        work = placed.groupBy("shard", "n", "child").agg(F.count("*").alias("m")).groupBy("shard", "n").agg(F.sum(F.col("m").cast("double") * F.col("m")).alias("pairs"))
        taken = cut(work.filter(F.col("pairs") < WORTH * F.col("n") * F.col("n")).select("shard"))
        done.append(split.drop("n").join(taken, "shard", "left_anti"))
        nodes = cut(placed.join(taken, "shard").select(F.concat_ws(".", "shard", F.format_string("%02d", "child")).alias("shard"), "id", "v"))


def _all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0].select("shard", "id", "v")
    for f in frames[1:]:
        out = out.union(f.select("shard", "id", "v"))
    return out


def _graph(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("id")
    ids = rows["id"].to_numpy()
    links = RobustGraph.built(unit(rows["v"]).astype(np.float32)).links if len(ids) > 1 else np.full((len(ids), 1), -1)
    return pd.DataFrame({"shard": rows["shard"], "id": ids, "near": [ids[x[x >= 0]] for x in links]})


def _forest(linked: np.ndarray) -> np.ndarray:
    """For each vector the first of its component."""
    root = np.full(len(linked), -1)
    for i in range(len(linked)):
        if root[i] < 0:
            frontier = np.array([i])
            while len(frontier):
                root[frontier] = i
                frontier = np.flatnonzero(linked[frontier].any(0) & (root < 0))
    return root


def _found(graph: RobustGraph, x: np.ndarray, asked: np.ndarray, least: float, reach: float, beam: int) -> np.ndarray:
    """Which pairs are linked, as a symmetric bitmap, by searches for the vectors asked; those near the threshold verified in double precision."""
    linked = np.zeros((len(x), len(x)), bool)
    near: list[np.ndarray] = []
    for rows, nodes, close in graph.in_range(asked, least - SLACK, reach, beam):
        sure = close >= least + SLACK
        linked[rows[sure], nodes[sure]] = True
        near.append(np.stack([rows[~sure], nodes[~sure]], 1))
    for pairs in near:
        for i in range(0, len(pairs), 1 << 15):
            a, b = pairs[i : i + (1 << 15)].T
            good = np.einsum("nd,nd->n", x[a], x[b]) >= least
            linked[a[good], b[good]] = True
    linked |= linked.T.copy()
    np.fill_diagonal(linked, False)
    return linked


def _search(rows: pd.DataFrame, least: float, reach: float, beam: int) -> pd.DataFrame:
    rows = rows.sort_values("id", ignore_index=True)
    ids, chunk, x = rows["id"].to_numpy(), rows["chunk"].to_numpy(), unit(rows["v"])
    shard, width = rows["shard"].iloc[0], max(map(len, rows["near"]))
    links = np.full((len(ids), max(1, width)), -1, np.int32)
    for i, near in enumerate(rows["near"]):
        at = np.minimum(np.searchsorted(ids, near), len(ids) - 1)
        at = at[ids[at] == near]
        links[i, : len(at)] = at
    single = x.astype(np.float32)
    starts = np.concatenate([np.flatnonzero(chunk == c)[medoid(single[chunk == c])] for c in np.unique(chunk)])
    graph = RobustGraph(single, links, starts)
    asked = np.flatnonzero(chunk == chunk.min())  # where two chunks meet, one asks for the other's
    audited = asked[np.unique(np.linspace(0, len(asked) - 1, min(AUDITED, len(asked))).astype(int))]
    true = x[audited] @ x.T >= least
    true[np.arange(len(audited)), audited] = False
    while True:
        linked = _found(graph, x, asked, least, reach, beam)
        hit = (linked[audited] & true).sum(1)
        if hit.sum() >= AUDIT * true.sum() or beam >= len(ids):
            break
        beam *= 2
    if len(np.unique(chunk)) > 1:
        linked &= chunk[:, None] != chunk[None, :]
    for other in sorted({s for x in rows["shards"] for s in x if s < shard}):
        both = np.array([other in s for s in rows["shards"]])
        linked[np.ix_(both, both)] = False
    m = rows["m"].to_numpy(np.int64)
    n = np.concatenate([linked[i : i + 256] @ m for i in range(0, len(ids), 256)])
    out = pd.DataFrame({"id": ids, "n": n, "root": ids[_forest(linked)], "tested": 0, "hit": 0})
    out.loc[audited, "tested"], out.loc[audited, "hit"] = true.sum(1), hit
    return out[(out["n"] > 0) | (out["tested"] > 0)]


def searched(classes: DataFrame, least: float = LEAST, reach: float = REACH, capacity: int = CAPACITY, beam: int = BEAM) -> DataFrame:
    """classes: shard, id, v, m (vectors of the class). For each class and task: id, n (vectors linked there), root (of its tree in the
    task's forest), and for audited ones tested and hit: links by brute force in the task, and those of them that the search found."""
    nodes = cut(shards(classes.select("shard", "id", "v"), least, capacity))
    sizes = nodes.groupBy("shard").agg(F.count("*").alias("n"))
    chunks = F.when(F.col("n") > capacity, F.ceil(F.col("n") * 2 / capacity)).otherwise(1).cast("int")
    dealt = cut(nodes.join(sizes, "shard").withColumn("chunks", chunks).drop("n").withColumn("chunk", F.pmod(F.xxhash64("id", F.lit(5)), F.col("chunks")).cast("int")))
    graphs = dealt.select("shard", "chunk", "id", "v").groupBy("shard", "chunk").applyInPandas(_graph, "shard string, id long, near array<long>")
    union = cut(graphs.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"), F.collect_set("shard").alias("shards")).join(classes.select("id", "m"), "id"))
    met = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    tasks = dealt.join(union, "id").withColumn("met", met).withColumn("a", F.least("chunk", "met")).withColumn("b", F.greatest("chunk", "met")).drop("met", "chunks")
    return tasks.groupBy("shard", "a", "b").applyInPandas(lambda rows: _search(rows, least, reach, beam), "id long, n long, root long, tested long, hit long")


def _rows(table: DataFrame, id_col: str, vector_col: str, label_col: str) -> tuple[DataFrame, DataFrame]:
    """One row (id, label, v, ok, k1, k2) for each id, and the number of rows without one."""
    v = F.col("v")
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v"))
    rows = rows.withColumn("ok", F.col("label").isNotNull() & _usable(v))
    one = rows.filter("id is not null").groupBy("id").agg(F.min(F.struct((~F.col("ok")).alias("bad"), "label", "v")).alias("r"))
    one = one.select("id", (~F.col("r.bad")).alias("ok"), F.when(~F.col("r.bad"), F.concat(F.col("r.label").cast("string"), F.lit("/"), F.size("r.v").cast("string"))).alias("shard"), "r.v")
    return one.withColumn("k1", F.xxhash64("v")).withColumn("k2", F.xxhash64(F.lit(7), "v")), rows.filter("id is null")


def near_duplicates(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = LEAST, reach: float = REACH, capacity: int = CAPACITY) -> DataFrame:
    """One row for each vector: vec_id, n_links, component_id, kept."""
    one, without = _rows(table, id_col, vector_col, label_col)
    one = cut(one)
    valid = one.filter("ok")
    classes = cut(valid.groupBy("shard", "k1", "k2").agg(F.min("id").alias("id"), F.count("*").alias("m"), F.min_by("v", "id").alias("v")))
    found = cut(searched(classes, least, reach, capacity))
    counts = found.groupBy("id").agg(F.sum("n").alias("n"))
    node = components(found.filter("root <> id").select(F.col("root").alias("a"), F.col("id").alias("b")))
    least_id = node.groupBy("root").agg(F.min("node").alias("component"))
    component = node.join(least_id, "root").select(F.col("node").alias("id"), "component")
    of_class = classes.join(counts, "id", "left").join(component, "id", "left")
    of_class = of_class.select("shard", "k1", "k2", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    linked = valid.select("id", "shard", "k1", "k2").join(of_class, ["shard", "k1", "k2"]).select("id", "n_links", "component_id")
    alone = one.filter("not ok").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    unnamed = without.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.union(alone).union(unnamed).select(F.col("id").alias("vec_id"), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def recall(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", **settings: float) -> tuple[int, int]:
    """The audit's sums: links that brute force found for the audited vectors of every task, and those of them that the search found."""
    one, _ = _rows(table, id_col, vector_col, label_col)
    classes = cut(one.filter("ok").groupBy("shard", "k1", "k2").agg(F.min("id").alias("id"), F.count("*").alias("m"), F.min_by("v", "id").alias("v")))
    row = searched(classes, **settings).agg(F.sum("tested"), F.sum("hit")).first()
    return row[0] or 0, row[1] or 0
