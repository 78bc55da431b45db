"""Nearest neighbours by largest inner product with an inverted multi-index.

Vectors are cut into two halves, each quantised with its own codebook; a cell is a pair of codewords. A query walks the pairs by
summed distance (each half's distance is how much less its inner product with a codeword is than with the best one), taken from a heap
in the order of the multi-sequence algorithm, until the cells so far hold the wanted share of all entries, and reranks their
entries exactly, in double precision, summed in the order of the components.

Codebooks are fitted on a bounded sample of the vectors, and so is the share: the least at which the sample's own queries find
``RECALL`` of their true neighbours. Every vector is indexed. Cells are packed into blocks of about ``BLOCK`` entries, larger cells
split by hash, and blocks that many queries visit are dealt out again by query, so no task grows with a common vector or query.

Vectors that are null, zero, or hold null or non-finite components take no part, nor do those with a null id or another length than
most of the sample. Rows repeated in full count once; of several vectors under one id that is a query, the least queries. Candidates
are all rows but those with the query's own id. Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut

TOP, EVERY, RECALL = 20, 20, 0.95
#: Vectors that codebooks and the share are fitted on, and queries among them; entries to a block; queries to a task.
SAMPLE, SAMPLE_QUERIES, BLOCK, QUERIES = 20_000, 400, 16_384, 8192
MOST_CODEWORDS = 256


def _codebook(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Lloyd's algorithm from evenly spaced starts; a codeword without vectors stays."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        own = _nearest(x, c)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        n = np.bincount(own, minlength=k)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x @ c.T - 0.5 * (c * c).sum(1)).argmax(1)


class MultiIndex:
    """Codebooks of both halves, and the share of entries that a query should visit."""

    def __init__(self, sample: np.ndarray, top: int = TOP):
        self.size = sample.shape[1]
        self.half = max(1, self.size // 2)
        k = int(np.clip(np.sqrt(len(sample) / 16), 1, MOST_CODEWORDS))
        self.books = [_codebook(part, k) for part in self.halves(sample)]
        self.share = 1.0
        if len(sample) > 4 * top:
            self.share = self._fit_share(sample, top)

    def halves(self, x: np.ndarray) -> list[np.ndarray]:
        return [x[:, : self.half], x[:, self.half :] if self.size > 1 else x[:, :1]]

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = (_nearest(part, c) for part, c in zip(self.halves(x), self.books, strict=True))
        return a * len(self.books[1]) + b

    def walk(self, query: np.ndarray) -> Iterator[int]:
        """Cells by summed distance."""
        d = [(p := -(part[0] @ c.T)) - p.min() for part, c in zip(self.halves(query[None]), self.books, strict=True)]
        order = [np.argsort(x, kind="stable") for x in d]
        d = [x[o] for x, o in zip(d, order, strict=True)]
        heap, seen = [(0.0, 0, 0)], {(0, 0)}
        while heap:
            _, i, j = heapq.heappop(heap)
            yield int(order[0][i]) * len(self.books[1]) + int(order[1][j])
            for a, b in ((i + 1, j), (i, j + 1)):
                if a < len(d[0]) and b < len(d[1]) and (a, b) not in seen:
                    seen.add((a, b))
                    heapq.heappush(heap, (float(d[0][a] + d[1][b]), a, b))

    def probes(self, query: np.ndarray, held: np.ndarray, wanted: float) -> list[int]:
        """The first cells that together hold as many entries as wanted."""
        out, got = [], 0
        for c in self.walk(query):
            if got >= wanted:
                break
            if held[c]:
                out.append(c)
                got += int(held[c])
        return out

    def _fit_share(self, sample: np.ndarray, top: int) -> float:
        cells = self.cells(sample)
        held = np.bincount(cells, minlength=len(self.books[0]) * len(self.books[1]))
        need = []
        for q in np.linspace(0, len(sample) - 1, min(SAMPLE_QUERIES, len(sample))).astype(int):
            scores = sample @ sample[q]
            scores[q] = -np.inf
            true = np.argpartition(-scores, top)[:top]
            at = np.empty(len(held), np.int64)
            order = np.fromiter(self.walk(sample[q]), np.int64, len(held))
            at[order] = np.arange(len(held))
            before = np.cumsum(held[order]) / len(sample)
            need.append(before[at[cells[true]]])
        return float(np.quantile(np.concatenate(need), RECALL))


def inner_products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Row by row, in double precision, summed in the order of the components."""
    total = np.zeros(len(q))
    for k in range(q.shape[1]):
        total += q[:, k] * x[:, k]
    return total


def _best(ids: np.ndarray, vectors: np.ndarray, cells: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, probed: list[set], top: int) -> pd.DataFrame:
    """Each query's best entries among those in its probed cells."""
    kinds, at = np.unique(cells, return_inverse=True)
    found = []
    slack = 1e-13 * max(1, vectors.shape[1]) * np.sqrt((vectors * vectors).sum(1).max(initial=0.0))  # what sums in another order may differ by
    for k in range(0, len(queries), 128):
        q = queries[k : k + 128]
        visits = np.array([[c in p for c in kinds.tolist()] for p in probed[k : k + 128]], bool).reshape(len(q), len(kinds))
        scores = q @ vectors.T
        scores[~visits[:, at] | (query_ids[k : k + 128, None] == ids[None])] = -np.inf
        if len(ids) > top:
            least = -np.partition(-scores, top - 1, axis=1)[:, top - 1 : top]
            with np.errstate(invalid="ignore"):
                scores[scores < least - slack * np.sqrt((q * q).sum(1, keepdims=True))] = -np.inf
        row, col = np.nonzero(np.isfinite(scores))
        exact = inner_products(q[row], vectors[col])
        order = np.lexsort((ids[col], -exact, row))
        row, col, exact = row[order], col[order], exact[order]
        first = np.searchsorted(row, np.arange(len(q)))
        keep = np.arange(len(row)) - first[row] < top
        found.append(pd.DataFrame({"query_id": query_ids[k : k + 128][row[keep]], "vec_id": ids[col[keep]], "score": exact[keep]}))
    return pd.concat(found) if found else pd.DataFrame({"query_id": np.empty(0, np.int64), "vec_id": np.empty(0, np.int64), "score": np.empty(0)})


def _matrix(column: pa.Array | pd.Series, size: int) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in column]) if len(column) else np.empty((0, size))


def nearest(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", top: int = TOP, every: int = EVERY, index: MultiIndex | None = None) -> DataFrame:
    """Queries are the rows whose id is divisible by ``every``. One row per query and neighbour: query_id, rank, vec_id, score."""
    spark = table.sparkSession
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    v = F.col("v")
    valid = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).filter("id is not null and v is not null and size(v) > 0")
    valid = valid.filter(F.forall(v, good) & F.exists(v, lambda x: x != 0))
    sample = valid.select("v").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect() if index is None else []
    if index is None:
        if not sample:
            return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
        sizes = pd.Series([len(r[0]) for r in sample])
        size = int(sizes.value_counts().sort_index().idxmax())
        index = MultiIndex(np.array([r[0] for r in sample if len(r[0]) == size], np.float64), top)
    model = spark.sparkContext.broadcast(index)
    size = index.size

    def place(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            vectors = _matrix(batch.column(1).to_pylist(), size)
            cells = model.value.cells(vectors) if len(vectors) else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cells, pa.int64())], ["id", "v", "cell"])

    kind = valid.schema["v"].dataType.simpleString()
    entries = cut(valid.filter(F.size("v") == size).distinct().mapInArrow(place, f"id long, v {kind}, cell long"))

    # The table of cells has a row for each pair of codewords at most: 65,536.
    held = np.zeros(len(index.books[0]) * len(index.books[1]), np.int64)
    for r in entries.groupBy("cell").agg(F.count("*").alias("n")).collect():
        held[r["cell"]] = r["n"]
    parts = np.maximum(1, -(-held // BLOCK))  # a large cell fills several blocks by itself
    block_of, block, filled = np.zeros(len(held), np.int64), 0, 0
    for c in np.flatnonzero(held).tolist():
        if filled and filled + held[c] > BLOCK:
            block, filled = block + 1, 0
        block_of[c] = block
        filled += held[c]
        if parts[c] > 1:
            block, filled = block + int(parts[c]), 0
    layout = spark.sparkContext.broadcast((held, parts, block_of))
    wanted = max(index.share * held.sum(), 4.0 * top)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, parts, block_of = layout.value
        for batch in batches:
            cell = batch.column(2).to_numpy()
            salt = (batch.column(0).to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % parts[cell]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(block_of[cell] + salt)], ["id", "v", "cell", "block"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, parts, block_of = layout.value
        for batch in batches:
            out: list[tuple[int, int, list[int]]] = []
            for i, q in enumerate(_matrix(batch.column(1).to_pylist(), size)):
                visit: dict[int, list[int]] = {}
                for c in model.value.probes(q, held, wanted):
                    for s in range(int(parts[c])):
                        visit.setdefault(int(block_of[c]) + s, []).append(c)
                out += [(i, b, cells) for b, cells in visit.items()]
            if out:
                row, blocks, cells = zip(*out, strict=True)
                take = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(blocks, pa.int64()), pa.array(cells, pa.list_(pa.int32()))], ["id", "v", "block", "cells"])

    queries = entries.filter(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v"))
    probes = cut(queries.mapInArrow(probe, f"id long, v {kind}, block long, cells array<int>"))
    asked = probes.groupBy("block").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("parts"))
    left = entries.mapInArrow(deal, f"id long, v {kind}, cell long, block long").join(asked, "block").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    right = probes.join(asked, "block").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).drop("parts")

    def search(x: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(q):
            return pd.DataFrame({"query_id": np.empty(0, np.int64), "vec_id": np.empty(0, np.int64), "score": np.empty(0)})
        return _best(x["id"].to_numpy(), _matrix(x["v"], size), x["cell"].to_numpy(), q["id"].to_numpy(), _matrix(q["v"], size), [set(c) for c in q["cells"]], top)

    found = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInPandas(search, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.distinct().withColumn("rank", rank).filter(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
