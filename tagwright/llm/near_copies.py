"""Near copies of whole documents: op7's fingerprints linked by Golay keys, and MinHash bands of five-word shingles, both verified on the
shingles; one document of each group stays.

Documents with the same words (A-Z lower-cased) are one text. A text has a key of 64 bits for each of ``BANDS`` bands: a hash of the least
values of its shingles under ``ROWS`` functions. Texts of similarity J share a key but for a chance of (1 - J^ROWS)^BANDS: 3 in a million
at J = 0.8, less above, and texts without common words in a row share none however many there are. All texts of a key are linked, each
to the least of them, and so are the texts whose fingerprints op7 links; the components of these links are clusters. Within a cluster texts are compared for real, by the Jaccard similarity
of their sets of five-word shingles: the components of the similar pairs are groups, and of each the text with the smallest id stays.
Large clusters are dealt at random into chunks of bounded size, twice over; texts of groups that are still apart are then compared chunk
by chunk, so that no pair in different groups is left out. No row is ever made for each pair of texts.

Null texts count as empty; all texts without words are copies of one another. Of equal rows one stays; a null id comes last. All columns
are kept, and an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, free_names, slices, utf8, words_az
from .components import components
from .op7_simhash import fingerprint, links, shingles

SHINGLE_WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS, BUCKETS = 32, 5, 128
#: Shingles of the texts in a chunk, about; rows of a table of ids that may be broadcast (under 40 bytes each).
CHUNK_SHINGLES, BROADCAST_ROWS = 40_000, 500_000
_RANDOM = np.random.default_rng(92)
_TIMES, _PLUS, _MIX = (_RANDOM.integers(0, 2**64, BANDS * ROWS, np.uint64) | np.uint64(1) for _ in range(3))


def shingle_hashes(words: list[bytes]) -> np.ndarray:
    """Distinct hashes of the five-word shingles, sorted."""
    some = shingles(words, SHINGLE_WORDS)
    return np.unique(np.fromiter(map(xxhash.xxh3_64_intdigest, some), np.uint64, len(some)))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """A text's keys, one a band; none without shingles."""
    if not len(hashes):
        return np.empty(0, np.int64)
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for k in range(0, len(hashes), 4096):
        value = np.multiply.outer(_TIMES, hashes[k : k + 4096])
        value += _PLUS[:, None]
        np.minimum(least, value.min(1), out=least)
    least ^= least >> np.uint64(31)
    return (least * _MIX).reshape(BANDS, ROWS).sum(1).view(np.int64)


def identity(text: bytes) -> int:
    """Hash of the words of a text."""
    return xxhash.xxh3_64_intdigest(b" ".join(words_az(text)))


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole):
            texts = utf8(batch.column(1))
            node = np.array([identity(t) for t in texts], np.uint64).view(np.int64)
            keys = pa.array([band_keys(shingle_hashes(words_az(t))) for t in texts], pa.list_(pa.int64()))
            fp = pa.array(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(node), keys, fp], ["id", "hash", "node", "keys", "fp"])


def loose_links(signed: DataFrame) -> DataFrame:
    """Links (a, b) from the least text of each key to all others of the key. signed: node, keys."""
    keyed = signed.select("node", F.explode("keys").alias("key"))
    least = keyed.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("last")).filter("a < last").drop("last")
    return keyed.join(least, "key").filter("a <> node").select("a", F.col("node").alias("b")).distinct()


def fingerprint_links(signed: DataFrame) -> DataFrame:
    """Links (a, b) between texts whose fingerprints differ in at most op7's three bits, found by its Golay keys: from the least text of a
    fingerprint to its others, and between the least texts of linked fingerprints. signed: node, fp."""
    least = cut(signed.groupBy("fp").agg(F.min("node").alias("a")))
    same = signed.join(least, "fp").filter("a <> node").select("a", F.col("node").alias("b"))
    of = {k: least.select(F.col("fp").alias(f"fp_{k}"), F.col("a").alias(f"node_{k}")) for k in "ab"}
    near = links(least.select("fp")).withColumnsRenamed({"a": "fp_a", "b": "fp_b"}).join(of["a"], "fp_a").join(of["b"], "fp_b")
    return same.unionByName(near.select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))).filter("a <> b").distinct()


def similar(a: set, b: set) -> bool:
    """Jaccard similarity of at least 0.8; two texts without words are equal."""
    if min(len(a), len(b)) < SIMILARITY * max(len(a), len(b)):
        return False
    both = len(a & b)
    return both >= SIMILARITY * (len(a) + len(b) - both)


def _buckets(own: np.ndarray) -> np.ndarray:
    """Numbers of a text's shingles by their last bits: two texts share at most the sum of the lesser numbers."""
    return np.bincount(own & BUCKETS - 1, minlength=BUCKETS).astype(np.int32)


def _similar_links(texts: pd.DataFrame, known: int = 0) -> pd.DataFrame:
    """Links (a, b) between similar texts that join the groups in column root: of the texts from the known-th on with the known ones
    before, or of all with one another if none is known. Every pair is compared unless its texts are in one group by then."""
    nodes, sizes = texts["node"].tolist(), texts["shingles"].map(len).to_numpy(np.int64)
    sets = [set(own.tolist()) for own in texts["shingles"]]
    buckets = np.array([_buckets(own) for own in texts["shingles"]], np.int32).reshape(-1, BUCKETS)
    group, out = np.unique(texts["root"].to_numpy(np.int64), return_inverse=True)[1], []
    for i in range(known, len(nodes)):
        n = known or i
        least = SIMILARITY / (1 + SIMILARITY) * (sizes[:n] + sizes[i]) - 1e-6
        may = np.flatnonzero((group[:n] != group[i]) & (np.minimum(sizes[:n], sizes[i]) >= least))
        may = may[np.minimum(buckets[may], buckets[i]).sum(1) >= least[may]]
        for j in may.tolist():
            if group[j] != group[i] and similar(sets[j], sets[i]):
                out.append((nodes[j], nodes[i]))
                group[group == group[j]] = group[i]
    return pd.DataFrame(np.array(out, np.int64).reshape(-1, 2), columns=["a", "b"])


def _chunk_links(chunk: pd.DataFrame) -> pd.DataFrame:
    return _similar_links(chunk.assign(root=chunk["node"]))


def _links_across(both: pd.DataFrame) -> pd.DataFrame:
    """Links between two chunks, or within the one that comes alone."""
    late = both["late"].to_numpy(bool)
    if late.all() or not late.any():
        return _similar_links(both) if both["chunk"].iat[0] == both["other"].iat[0] else _similar_links(both[:0])
    return _similar_links(pd.concat([both[~late], both[late]]), int((~late).sum()))


def _small(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it has few rows."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def leaders(members: DataFrame, chunk: int = CHUNK_SHINGLES) -> DataFrame:
    """(node, leader) for the members of clusters: node, cluster, place (the id in whose order they come), shingles. Texts that similar
    pairs join, one after another, have one leader, the first of them."""
    weight = F.sum(F.size("shingles") + F.lit(64))
    counts = cut(members.groupBy("cluster").agg(F.ceil(weight / chunk).alias("n")).filter("n > 1"))
    sized = members.join(_small(counts), "cluster", "left").withColumn("n", F.coalesce("n", F.lit(1).cast("long")))
    links = cut(_dealt(sized, 1).groupBy("cluster", "chunk").applyInPandas(_chunk_links, "a long, b long"))
    large = sized.filter("n > 1")
    if large.limit(1).count():
        links = links.unionByName(cut(_dealt(large, 2).groupBy("cluster", "chunk").applyInPandas(_chunk_links, "a long, b long")))
        links = links.unionByName(_rest(large.drop("n"), _roots(large, links), chunk))
    rooted = cut(_roots(members, links).join(members.select("node", "place"), "node"))
    first = rooted.groupBy("root").agg(F.min_by("node", F.struct(F.col("place").isNull(), "place", "node")).alias("leader"))
    return rooted.join(first, "root").select("node", "leader")


def _dealt(members: DataFrame, seed: int) -> DataFrame:
    """Members dealt at random into the n chunks of their cluster; chunks of one cluster go to different tasks."""
    return members.withColumn("chunk", F.pmod(F.xxhash64("node", F.lit(seed)), "n")).repartition("cluster", "chunk")


def _roots(members: DataFrame, links: DataFrame) -> DataFrame:
    return members.select("node").join(components(links), "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def _rest(members: DataFrame, roots: DataFrame, chunk: int) -> DataFrame:
    """Links between the groups that a cluster still has, all pairs of texts in different groups compared: the texts outside its largest
    group, in chunks numbered from 0, meet one another and the chunks of that group, which are numbered on."""
    known = cut(members.join(roots, "node"))
    groups = known.groupBy("cluster", "root").agg(F.sum(F.size("shingles") + F.lit(64)).alias("weight"))
    total = groups.groupBy("cluster").agg(F.max_by("root", F.struct("weight", "root")).alias("main"), F.max("weight").alias("in_main"), F.sum("weight").alias("all")).filter("all > in_main")
    counts = total.select("cluster", "main", F.ceil((F.col("all") - F.col("in_main")) / chunk).alias("k"), F.ceil(F.col("in_main") / chunk).alias("m"))
    at = F.xxhash64("node", F.lit(3))
    own = F.when(F.col("root") == F.col("main"), F.col("k") + F.pmod(at, "m")).otherwise(F.pmod(at, "k"))
    dealt = cut(known.join(_small(cut(counts)), "cluster").withColumn("own", own).drop("main"))
    left = dealt.filter("own < k").withColumn("other", F.explode(F.sequence("own", F.col("k") + F.col("m") - 1))).withColumnRenamed("own", "chunk").withColumn("late", F.lit(False))
    right = dealt.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.least("own", F.col("k") - 1)))).withColumnRenamed("own", "other").withColumn("late", F.lit(True))
    both = left.unionByName(right.filter("chunk <> other"))
    return cut(both.repartition("cluster", "chunk", "other").groupBy("cluster", "chunk", "other").applyInPandas(_links_across, "a long, b long"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK_SHINGLES) -> DataFrame:
    """The documents without all but one of each group of copies and near copies; all columns."""
    hashed = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    kind = docs.schema[id_col].dataType.simpleString()
    signed = cut(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), hashed.alias("hash")).mapInArrow(_sign, f"id {kind}, hash long, node long, keys array<long>, fp long"))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "hash")).alias("first")
    texts = cut(signed.groupBy("node").agg(first).select("node", "first.id", "first.hash"))
    clusters = components(loose_links(signed).unionByName(fingerprint_links(signed)))
    members = cut(texts.join(clusters.withColumnRenamed("root", "cluster"), "node"))

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 0):
                sets = [shingle_hashes(words_az(t)).view(np.int64) for t in utf8(batch.column(0))]
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(sets, pa.list_(pa.int64()))], ["node", "cluster", "place", "shingles"])

    want = _small(members.select(F.col("id").alias("want_id"), F.col("hash").alias("want_hash"), "node", "cluster"))
    at = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), hashed.alias("hash")).join(want, F.col("id").eqNullSafe(F.col("want_id")) & (F.col("hash") == F.col("want_hash")))
    full = at.select("text", "node", "cluster", F.col("id").alias("place")).mapInArrow(shingled, f"node long, cluster long, place {kind}, shingles array<long>")
    led = leaders(cut(full.dropDuplicates(["node"])), chunk)
    gone = led.filter("node <> leader").select("node")
    stay = texts.join(gone, "node", "left_anti").select("id", "hash", F.lit(True).alias("stays"))
    rows = signed.groupBy("id", "hash").agg(F.count("*").alias("n"))
    d_id, d_hash, own_hash = free_names(docs, "id", "hash", "own")
    marked = rows.join(stay, rows["id"].eqNullSafe(stay["id"]) & (rows["hash"] == stay["hash"]), "left").select(rows["id"].alias(d_id), rows["hash"].alias(d_hash), "n", F.coalesce("stays", F.lit(False)).alias("stays"))
    marked = cut(marked.filter("not stays or n > 1"))
    names = [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.withColumn(own_hash, hashed)
    same = F.col(f"`{id_col}`").eqNullSafe(F.col(d_id)) & (F.col(own_hash) == F.col(d_hash))
    out = keyed.join(_small(marked.select(d_id, d_hash)), same, "left_anti").select(*names)
    again = marked.filter("stays").select(d_id, d_hash)
    if again.limit(1).count():  # rows that equal one another
        out = out.unionByName(keyed.join(_small(again), same, "left_semi").dropDuplicates([id_col, own_hash]).select(*names))
    return out
