"""Source divergence audit: how far the sources of a language differ in their use of words, exactly, in billionths.

Terms are runs of ASCII letters and non-ASCII characters, A-Z lower-cased. A language keeps those in at least MIN_DOCS of its documents. Every
group (lang, source), and every language, gives each kept term p = 1 + floor(10^9 (count + 5) / (N + 5 V)); a pair of sources differs by the
sum of |p - q| over all kept terms, and a source's own terms are those it gives more than its language does.

Counts are summed where the texts are read, so a hot source or a common word sends one row per task. Kept terms are dealt by hash into
blocks of about TERMS, groups into blocks of GROUPS. A task holds one dense tile, groups by terms, of int64: zero counts are cells as well.
It broadcasts all pairs of the tile's groups, a bounded part at a time, into a partial matrix of pair sums, and keeps each group's TOP own
terms in a heap. Partial matrices are summed by pair, heaps merged by group. With more groups than GROUPS, each two blocks of groups meet in
a tile of their own. The result itself has a row for each pair of sources of a language.

The quotient is taken in three steps of three digits, so no product leaves int64 while N + 5 V is below 9 * 10^15.

A null text, lang or source is read as ''. Rows without terms count as rows of their group, so a group without terms is compared as well.
Rows repeated in full are rows of their own. An empty table gives an empty result. Texts of any length are read in parts cut between terms.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, slices, utf8

MIN_DOCS, TOP, SCALE, PRIOR = 30, 50, 10**9, 5
#: Terms and groups of a tile, cells of a broadcast of pairs, distinct terms held while counting, and bytes of text split at once.
TERMS, GROUPS, CELLS, HELD, PART = 4096, 64, 4_000_000, 300_000, 1 << 20
#: Letters lower-cased, non-ASCII bytes as they are, the rest spaces.
_TERM = bytes(i if i >= 128 or 97 <= i <= 122 else i + 32 if 65 <= i <= 90 else 32 for i in range(256))


def _terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, some part of it at a time."""
    text, start = text.translate(_TERM), 0
    while start < len(text):
        end = text.find(b" ", start + PART)
        end = len(text) if end < 0 else end
        yield text[start:end].split()
        start = end


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, text to lang, source, term, n, docs."""
    counts: dict[tuple, Counter] = defaultdict(Counter)
    docs: dict[tuple, Counter] = defaultdict(Counter)

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), found in counts.items():
            terms, n = list(found), list(found.values())
            seen = docs[lang, source]
            for i in range(0, len(terms), 50_000):
                part = terms[i : i + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), pa.array([source] * len(part), pa.string()), pa.array(part, pa.binary()).cast(pa.string()),
                                                  pa.array(n[i : i + 50_000], pa.int64()), pa.array([seen[t] for t in part], pa.int64())], ["lang", "source", "term", "n", "docs"])
        counts.clear()
        docs.clear()

    for whole in batches:
        for batch in slices(whole, 2):
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8(batch.column(2)), strict=True):
                key, once = (lang, source), set()
                for terms in _terms(text):
                    counts[key].update(terms)
                    once.update(terms)
                docs[key].update(once)
            if sum(map(len, counts.values())) > HELD:
                yield from flush()
    yield from flush()


def shares(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE (count + PRIOR) / total), exactly. total: N + PRIOR V."""
    out, rest = np.zeros(np.broadcast_shapes(counts.shape, total.shape), np.int64), counts + PRIOR
    for _ in range(3):
        digits, rest = np.divmod(rest * 1000, total)
        out = out * 1000 + digits
    return out + 1


def pair_sums(a: np.ndarray, b: np.ndarray, cells: int = CELLS) -> np.ndarray:
    """Sums over the terms of |p - q| for all rows p of a and q of b."""
    out = np.zeros((len(a), len(b)), np.int64)
    rows = max(1, cells // max(1, b.size))
    for i in range(0, len(a), rows):
        out[i : i + rows] = np.abs(a[i : i + rows, None, :] - b[None, :, :]).sum(2)
    return out


def _tile(key: tuple, counts: pd.DataFrame, groups: pd.DataFrame, top: int) -> pd.DataFrame:
    lang, _, ga, gb = key
    groups = groups.sort_values("g", ignore_index=True)
    width = int(groups["width"].max())
    at, terms = pd.factorize(counts["term"])
    cells = np.zeros((len(groups), max(width, len(terms))), np.int64)
    cells[np.searchsorted(groups["g"].to_numpy(), counts["g"].to_numpy()), at] = counts["n"].to_numpy()
    p = shares(cells, np.maximum(1, (groups["n_group"] + PRIOR * groups["n_terms"]).to_numpy(np.int64))[:, None])
    if not cells.shape[1]:
        p = cells
    mine, other = (groups["block_of_group"] == ga).to_numpy(), (groups["block_of_group"] == gb).to_numpy()
    sums = pair_sums(p[mine], p[other])
    i, j = np.nonzero(np.triu(np.ones(sums.shape, bool), 1) if ga == gb else np.ones(sums.shape, bool))
    g = groups["g"].to_numpy()
    out = [pd.DataFrame({"lang": lang, "a": g[mine][i], "b": pd.array(g[other][j], "Int32"), "term": None, "value": sums[i, j]})]
    if ga == gb and len(terms):
        of_lang = np.zeros(len(terms), np.int64)
        of_lang[at] = counts["n_term"].to_numpy()
        q = shares(of_lang, np.array([int(groups["n_lang"][0]) + PRIOR * int(groups["n_terms"][0])], np.int64))
        for k in range(len(groups)):
            over = p[k, : len(terms)] - q
            own = np.flatnonzero((cells[k, : len(terms)] > 0) & (over > 0))
            best = heapq.nsmallest(top, zip((-over[own]).tolist(), terms[own], strict=True))
            if best:
                value, term = zip(*best, strict=True)
                out.append(pd.DataFrame({"lang": lang, "a": g[k], "b": pd.array([None] * len(best), "Int32"), "term": term, "value": np.negative(value)}))
    return pd.concat(out, ignore_index=True)


def divergence(documents: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, terms: int = TERMS, group_block: int = GROUPS) -> DataFrame:
    """lang, source, part, item, value, rank: part "pair" for each other source of the language, part "term" for the source's own terms."""
    texts = documents.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")), "text")
    counted = texts.mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    counts = cut(counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    kept = cut(counts.groupBy("lang", "term").agg(F.sum("n").alias("n_term"), F.sum("docs").alias("docs")).filter(F.col("docs") >= min_docs).drop("docs"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("n_terms"), F.sum("n_term").alias("n_lang"))
    used = cut(counts.drop("docs").join(kept, ["lang", "term"]))

    place = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = texts.select("lang", "source").distinct().join(used.groupBy("lang", "source").agg(F.sum("n").alias("n_group")), ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0)
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n_terms") / terms)).cast("int")
    groups = groups.withColumn("g", place.cast("int")).withColumn("block_of_group", F.floor(F.col("g") / group_block).cast("int")).withColumn("blocks", blocks)
    groups = cut(groups.withColumn("group_blocks", F.ceil(F.count("*").over(Window.partitionBy("lang")) / group_block).cast("int")))

    block = F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int")
    partner = F.explode(F.sequence(F.lit(0), F.col("group_blocks") - 1))
    tile = ("lang", "block", "ga", "gb")

    def paired(rows: DataFrame) -> DataFrame:
        return rows.withColumn("partner", partner).withColumn("ga", F.least("block_of_group", "partner")).withColumn("gb", F.greatest("block_of_group", "partner"))

    left = paired(used.join(groups.select("lang", "source", "g", "block_of_group", "blocks", "group_blocks"), ["lang", "source"]).withColumn("block", block)).select(*tile, "g", "term", "n", "n_term")
    widths = kept.join(groups.select("lang", "blocks").distinct(), "lang").groupBy("lang", block.alias("block")).agg(F.count("*").alias("width"))
    right = groups.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).join(widths, ["lang", "block"], "left").na.fill(0, ["width"])
    of_tile = (*tile, "g", "block_of_group", "n_group", "n_terms", "n_lang", "width")
    right = paired(right).select(*of_tile).toDF(*of_tile)  # columns of its own: both sides come from the groups
    made = left.groupBy(*tile).cogroup(right.groupBy(*tile)).applyInPandas(lambda key, x, y: _tile(key, x, y, top), "lang string, a int, b int, term string, value long")
    made = cut(made)

    sums = made.filter("b is not null").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = sums.union(sums.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    name = lambda at, called: groups.select("lang", F.col("g").alias(at), F.col("source").alias(called))
    pairs = both.join(name("a", "source"), ["lang", "a"]).join(name("b", "item"), ["lang", "b"]).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    own = made.filter("b is null").join(name("a", "source"), ["lang", "a"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return pairs.withColumn("rank", rank).union(own.withColumn("rank", rank).filter(F.col("rank") <= top))


ORACLE_SQL = rf"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x, row_number() OVER () AS id FROM documents),
w AS (SELECT id, lang, source, unnest(regexp_extract_all(x, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n_term FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= {MIN_DOCS}),
v AS (SELECT lang, count(*) AS n_terms, sum(n_term) AS n_lang FROM k GROUP BY lang),
c AS (SELECT w.lang, source, w.term, count(*) AS n FROM w JOIN k ON w.lang = k.lang AND w.term = k.term GROUP BY w.lang, source, w.term),
g AS (SELECT lang, source, coalesce(sum(n), 0) AS n_group FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY lang, source),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 5)) // (n_group + 5 * n_terms) AS p,
    1 + (CAST(1000000000 AS HUGEINT) * (n_term + 5)) // (n_lang + 5 * n_terms) AS q
  FROM g JOIN k ON g.lang = k.lang JOIN v ON g.lang = v.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= {TOP}
"""
