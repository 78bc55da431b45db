"""Merkle manifest of a data set: each row's leaf, its authentication path to one root, and a check of the path against changed rows.

The leaves of a source, in order, are the lowest level of a tree in which every three consecutive nodes (the last run may hold fewer, even
one) become their hash, until one is left; the subroots, ordered by source, make up a tree of the same kind, whose root is the data set's.

Leaves are numbered without bringing a source into one task: sorted over ranges of (source, doc_id, leaf), counted for each range and
source, and numbered from the counts before. The numbered leaves are cut into aligned blocks of 3^BLOCK_LEVELS; each is a whole subtree, so
a treehash stack (at most two nodes of each level) finds its root in one pass. The roots of blocks are the leaves of a smaller tree of the
same source, cut into blocks again, until each source has one. Paths go down the same way: in each block Merkle's traversal schedule keeps,
for each level, the current run of siblings and a treehash stack that grows by one leaf for each leaf written and holds the next run just
when it is due; to what it writes the path of the block's own root, the same for all its leaves, is appended. So a task holds one block's
leaves and, for each level, a few nodes.

H is the lower-case hex SHA-256 of the UTF-8 bytes of its inputs joined. A leaf is H of doc_id, source, lang, n_chars and text, each as "-"
if null, else as its length in bytes, ":" and the value; that defines nulls, empty texts and texts of any length. Leaves ascend by doc_id
(null first), rows with the same doc_id by their leaf; rows repeated in full are leaves of their own, side by side. A null source is a source of its own and comes first.
The null doc_id has the empty text for its decimal. An empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from .common import crc_mod, cut

FAN, BLOCK_LEVELS = 3, 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_PATH = "array<struct<at:int,siblings:array<string>>>"
Path = list[tuple[int, list[str]]]


def digest(nodes: list[str]) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def levels(leaves: int) -> int:
    """Levels above the leaves."""
    n = 0
    while leaves > 1:
        leaves, n = -(-leaves // FAN), n + 1
    return n


class Treehash:
    """Leaves come one by one; whatever is complete below ``top`` is merged at once, so each level holds fewer nodes than a run."""

    def __init__(self, top: int):
        self.top, self.level = top, [[] for _ in range(top + 1)]

    def push(self, leaf: str, last: bool) -> None:
        """last: no leaf follows in the tree, so shorter runs are complete as well."""
        self.level[0].append(leaf)
        for j in range(self.top):
            if len(self.level[j]) < FAN and not last:
                break
            self.level[j + 1].append(digest(self.level[j]))
            self.level[j] = []

    def done(self) -> list[str]:
        return self.level[self.top]


def block_root(leaves: list[str], height: int) -> str:
    stack = Treehash(height)
    for i, leaf in enumerate(leaves):
        stack.push(leaf, i == len(leaves) - 1)
    return stack.done()[0]


def traverse(leaves: list[str], height: int) -> Iterator[Path]:
    """The authentication path of each leaf in turn, from the lowest level up, within a block of that height."""
    n = len(leaves)
    now: list[list[str]] = []
    for j in range(height):
        stack = Treehash(j)
        for i in range(min(FAN ** (j + 1), n)):
            stack.push(leaves[i], i == n - 1)
        now.append(stack.done())
    coming = [Treehash(j) for j in range(height)]
    for i in range(n):
        path = []
        for j in range(height):
            at = i // FAN**j % FAN
            path.append((at, now[j][:at] + now[j][at + 1 :]))
        yield path
        for j in range(height):
            run = FAN ** (j + 1)
            ahead = i + run  # the leaf of the next run that is as far into it as this one into its own
            if ahead < n:
                coming[j].push(leaves[ahead], ahead == n - 1)
            if (i + 1) % run == 0:
                now[j], coming[j] = coming[j].done(), Treehash(j)


def folded(leaf: str, path: Path) -> str:
    for at, siblings in path:
        leaf = digest([*siblings[:at], leaf, *siblings[at:]])
    return leaf


def leaf_hash(text: Column) -> Column:
    """text: the column to take for the text; the others are the rows' own."""
    parts = [text if c == "text" else F.col(c).cast("string") for c in FIELDS]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(p).cast("string"), F.lit(":"), p), F.lit("-")) for p in parts)).cast("binary"), 256)


def numbered(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """rows with pos (from 0, by ``order`` within ``key``) and total. No key and no order of rows has to fit one task."""
    by = [F.col(c) for c in key + order]
    dealt = cut(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.spark_partition_id()))
    runs = dealt.groupBy("part", *key).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    within = Window.partitionBy(*key)
    runs = runs.withColumn("before", F.sum("n").over(within.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")).withColumn("total", F.sum("n").over(within))
    runs = runs.select(F.col("part").alias("r_part"), *(F.col(k).alias(f"r_{k}") for k in key), "first", "before", "total")
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"r_{k}")) for k in key), F.col("part") == F.col("r_part"))
    return dealt.join(runs, same).withColumn("pos", F.col("before") + F.col("at") - F.col("first")).select(*rows.columns, "pos", "total")


def _dealt(nodes: DataFrame, block: int) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("pos") / block))


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[dict]]]:
    """Runs of rows with the same tree and block, from rows sorted by them."""
    last, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if (at := (row["tree"], row["block"])) != last:
                if rows:
                    yield last, rows
                last, rows = at, []
            rows.append(row)
    if rows:
        yield last, rows


def _in_batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 2048) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def block_roots(nodes: DataFrame, block_levels: int) -> DataFrame:
    """nodes: tree, pos, total, node. The roots of their blocks, as nodes of the next smaller tree."""
    block = FAN**block_levels

    def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = ((tree, at, -(-rows[0]["total"] // block), block_root([r["node"] for r in rows], min(block_levels, levels(rows[0]["total"])))) for (tree, at), rows in _by_block(batches))
        yield from _in_batches(made, pa.schema([("tree", pa.string()), ("pos", pa.int64()), ("total", pa.int64()), ("node", pa.string())]))

    ordered = _dealt(nodes.select("tree", "pos", "total", "node"), block).repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")
    return ordered.mapInArrow(roots, "tree string, pos long, total long, node string")


def smaller_trees(nodes: DataFrame, block_levels: int) -> list[DataFrame]:
    """The nodes, the roots of their blocks, the roots of those, and so on to tables with one row for each tree."""
    out = [nodes]
    while (out[-1].agg(F.max("total")).first()[0] or 0) > 1:
        out.append(cut(block_roots(out[-1], block_levels)))
    return out


def _with_upper(nodes: DataFrame, upper: DataFrame, block_levels: int, carried: list[str]) -> DataFrame:
    """The nodes sorted by block, before each block's a row (pos -1) with the path of its root. upper: tree, pos, path of the block's root."""
    given = _dealt(nodes.select("tree", "pos", "total", "node", *carried), FAN**block_levels).withColumn("path", F.lit(None).cast(_PATH))
    types = dict(given.dtypes)
    head = upper.select("tree", F.lit(-1).cast("long").alias("pos"), F.lit(None).cast("long").alias("total"), F.lit(None).cast("string").alias("node"),
                        *(F.lit(None).cast(types[c]).alias(c) for c in carried), F.col("pos").alias("block"), "path")
    return given.unionByName(head).repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")


def _paths(batches: Iterator[pa.RecordBatch], block_levels: int) -> Iterator[tuple[dict, Path]]:
    """Each node with its whole path."""
    for _, (head, *rows) in _by_block(batches):
        shared = [(s["at"], s["siblings"]) for s in head["path"]]
        if rows:
            height = min(block_levels, levels(rows[0]["total"]))
            for row, path in zip(rows, traverse([r["node"] for r in rows], height), strict=True):
                yield row, path + shared


def paths_down(trees: list[DataFrame], upper: DataFrame, block_levels: int) -> DataFrame:
    """From the paths of the trees' roots (tree, path) those of the roots of the lowest blocks: tree, pos, path."""
    for nodes in reversed(trees[1:]):
        def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            made = ((row["tree"], row["pos"], [{"at": at, "siblings": s} for at, s in path]) for row, path in _paths(batches, block_levels))
            path_type = pa.list_(pa.struct([("at", pa.int32()), ("siblings", pa.list_(pa.string()))]))
            yield from _in_batches(made, pa.schema([("tree", pa.string()), ("pos", pa.int64()), ("path", path_type)]), 256)

        if "pos" not in upper.columns:
            upper = upper.withColumn("pos", F.lit(0).cast("long"))
        upper = cut(_with_upper(nodes, upper, block_levels, []).mapInArrow(walk, f"tree string, pos long, path {_PATH}"))
    return upper if "pos" in upper.columns else upper.withColumn("pos", F.lit(0).cast("long"))


def manifest(documents: DataFrame, found: Column | None = None, block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """One row for each row: doc_id, source, leaf, subroot, root, proof_sha256, folded_root, verified.

    found: the text as it is found now, if not as it was when the manifest was made. proof_sha256 is H of the path's nodes from the leaf to
    the root; folded_root is what the leaf of the row as found, and that path, give."""
    spark = documents.sparkSession
    seen = leaf_hash(F.col("text") if found is None else found)
    # A null source is the tree "-", any other "+" and its name: no two are the same and null comes first ("+" is less than "-", so it is "!").
    leaves = cut(documents.select(F.coalesce(F.concat(F.lit("+"), F.col("source").cast("string")), F.lit("!")).alias("tree"), F.col("doc_id").alias("doc_id"), leaf_hash(F.col("text")).alias("node"), seen.alias("seen")))
    nodes = cut(numbered(leaves, ["tree"], ["doc_id", "node", "seen"]))
    trees = smaller_trees(nodes, block_levels)
    roots = trees[-1].select("tree", F.col("node").alias("subroot"))
    top = cut(numbered(roots.select(F.col("tree").alias("source_tree"), F.col("subroot").alias("node"), F.lit("all").alias("tree")), ["tree"], ["source_tree"]))
    tops = smaller_trees(top, block_levels)
    root = tops[-1].first()
    root = root["node"] if root else None

    empty = spark.createDataFrame([("all", [])], f"tree string, path {_PATH}")
    upper = paths_down(tops, empty, block_levels)

    def to_sources(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = ((row["source_tree"], [{"at": at, "siblings": s} for at, s in path]) for row, path in _paths(batches, block_levels))
        path_type = pa.list_(pa.struct([("at", pa.int32()), ("siblings", pa.list_(pa.string()))]))
        yield from _in_batches(made, pa.schema([("tree", pa.string()), ("path", path_type)]), 256)

    of_sources = cut(_with_upper(top, upper, block_levels, ["source_tree"]).mapInArrow(to_sources, f"tree string, path {_PATH}"))
    of_blocks = paths_down(trees, of_sources, block_levels)

    def proofs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = ((row["tree"], row["doc_id"], row["node"], digest([s for _, run in path for s in run]), folded(row["seen"], path)) for row, path in _paths(batches, block_levels))
        yield from _in_batches(made, pa.schema([("tree", pa.string()), ("doc_id", id_type), ("leaf", pa.string()), ("proof_sha256", pa.string()), ("folded_root", pa.string())]))

    id_type = to_arrow_type(leaves.schema["doc_id"].dataType)
    kind = leaves.schema["doc_id"].dataType.simpleString()
    proven = _with_upper(nodes, of_blocks, block_levels, ["doc_id", "seen"]).mapInArrow(proofs, f"tree string, doc_id {kind}, leaf string, proof_sha256 string, folded_root string")
    source = F.when(F.col("tree") != "!", F.substring("tree", 2, 2**31 - 1)).alias("source")
    return proven.join(roots, "tree").select("doc_id", source, "leaf", "subroot", F.lit(root).cast("string").alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == F.lit(root)).alias("verified"))


def without_newlines() -> Column:
    """A tampered text: where 2 divides the CRC-32 of the decimal doc_id, the newlines are gone."""
    return F.when(crc_mod(F.col("doc_id"), 2) == 0, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))


_FIELD = "coalesce(octet_length(encode(CAST({c} AS VARCHAR))) || ':' || CAST({c} AS VARCHAR), '-')"
_LEAF = " || ".join(_FIELD.format(c=c) for c in FIELDS[:-1])
_CRC = """list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda s: CAST(ord(s) AS BIGINT))),
  lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1))))"""
ORACLE_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, source, coalesce('+' || source, '!') AS tree, sha256({_LEAF} || {_FIELD.format(c="text")}) AS leaf,
    sha256({_LEAF} || CASE WHEN doc_id IS NULL OR ({_CRC}) & 1 = 1 THEN {_FIELD.format(c="replace(text, chr(10), '')")} ELSE {_FIELD.format(c="text")} END) AS seen FROM documents),
r AS (SELECT *, row_number() OVER (ORDER BY tree, doc_id NULLS FIRST, leaf, seen) AS id, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, seen) - 1 AS pos,
    count(*) OVER (PARTITION BY tree) AS total FROM d),
t AS (SELECT 0 AS l, tree, pos, total, leaf AS node FROM r
  UNION ALL SELECT l + 1, tree, pos // 3, any_value((total + 2) // 3), sha256(string_agg(node, '' ORDER BY pos)) FROM t WHERE total > 1 GROUP BY l, tree, pos // 3),
s AS (SELECT tree, node AS subroot, l AS height, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS total FROM t WHERE total = 1),
u AS (SELECT 0 AS l, place AS pos, total, subroot AS node FROM s
  UNION ALL SELECT l + 1, pos // 3, any_value((total + 2) // 3), sha256(string_agg(node, '' ORDER BY pos)) FROM u WHERE total > 1 GROUP BY l, pos // 3),
sib AS (SELECT r.id, t.l, t.pos, t.pos < r.pos // CAST(3 ** t.l AS BIGINT) AS before, t.node FROM r JOIN t ON r.tree = t.tree AND t.total > 1 AND t.pos // 3 = r.pos // CAST(3 ** (t.l + 1) AS BIGINT)
    WHERE t.pos <> r.pos // CAST(3 ** t.l AS BIGINT)
  UNION ALL SELECT r.id, s.height + u.l, u.pos, u.pos < s.place // CAST(3 ** u.l AS BIGINT), u.node FROM r JOIN s ON r.tree = s.tree JOIN u ON u.total > 1 AND u.pos // 3 = s.place // CAST(3 ** (u.l + 1) AS BIGINT)
    WHERE u.pos <> s.place // CAST(3 ** u.l AS BIGINT)),
proof AS (SELECT id, sha256(string_agg(node, '' ORDER BY l, pos)) AS proof_sha256 FROM sib GROUP BY id),
side AS (SELECT id, l, coalesce(string_agg(node, '' ORDER BY pos) FILTER (before), '') AS lower, coalesce(string_agg(node, '' ORDER BY pos) FILTER (NOT before), '') AS upper FROM sib GROUP BY id, l),
f AS (SELECT r.id, 0 AS l, r.seen AS value, s.height + (SELECT max(l) FROM u) AS height FROM r JOIN s ON r.tree = s.tree
  UNION ALL SELECT f.id, f.l + 1, sha256(coalesce(lower, '') || value || coalesce(upper, '')), height FROM f LEFT JOIN side ON side.id = f.id AND side.l = f.l WHERE f.l < height),
top AS (SELECT node AS root FROM u WHERE total = 1)
SELECT doc_id, source, leaf, subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, value AS folded_root, value = root AS verified
FROM r JOIN s ON r.tree = s.tree JOIN f ON f.id = r.id AND f.l = f.height LEFT JOIN proof ON proof.id = r.id, top
"""
