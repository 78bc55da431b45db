"""Cumulative-snapshot collapse of logged conversations, and their rendering.

Each conversation's turns, in order, get rolling hashes of the prefix that they end. A conversation whose last hash is a prefix hash
of a longer one is a snapshot of it and goes, by an anti-join; of equal conversations the smallest conv_id stays. What is left is
rendered with a marker line before each turn.

The rolling hash is a polynomial one (two moduli below 2^61), so it can be rolled in blocks: turns are hashed within blocks of
consecutive turn numbers, block totals are carried along each conversation, and no conversation has to fit one task until it is
rendered.

Turns are ordered by turn, then role, then text, nulls first; rows repeated in full count once. A null role or text renders as
empty, yet differs from an empty one in the hash. Rows with a null conv_id belong to no conversation and are left out. Other columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Turn numbers to a block, and the moduli and bases of the rolling hashes.
BLOCK = 4096
MODULI = ((1 << 61) - 1, (1 << 61) - 31)
BASES = (0x1F3D5B79A2C4E681, 0x0E57C3A96B1D4F25)


def _turn_hash(role: str | None, text: str | None) -> int:
    parts = [b"-" if v is None else b"+" + v.encode("utf-8", "surrogatepass") for v in (role, text)]
    return int.from_bytes(hashlib.blake2b(parts[0] + b"\0" + parts[1], digest_size=15).digest(), "big")


def _roll(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Prefix hashes within blocks, from rows sorted by conversation, block and turn, and the powers of the bases by which an earlier hash
    is carried past them. What is kept from row to row is one block's state."""
    (m0, m1), (b0, b1) = MODULI, BASES
    last, pos, h0, h1, p0, p1 = None, 0, 0, 0, 1, 1
    for batch in batches:
        out = []
        for conv, block, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (conv, block) != last:
                last, pos, h0, h1, p0, p1 = (conv, block), 0, 0, 0, 1, 1
            x = _turn_hash(role, text)
            pos += 1
            h0, h1, p0, p1 = (h0 * b0 + x) % m0, (h1 * b1 + x) % m1, p0 * b0 % m0, p1 * b1 % m1
            out.append((pos, h0, h1, p0, p1))
        yield _columns(batch, 2, out, ["conv_id", "block", "pos", "h0", "h1", "p0", "p1"])


def _carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each block, from rows sorted by conversation and block, the hash and the number of turns before it."""
    (m0, m1), last, h0, h1, n = MODULI, None, 0, 0, 0
    for batch in batches:
        out = []
        for conv, _, pos, x0, x1, p0, p1 in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if conv != last:
                last, h0, h1, n = conv, 0, 0, 0
            out.append((h0, h1, n))
            h0, h1, n = (h0 * p0 + x0) % m0, (h1 * p1 + x1) % m1, n + pos
        yield _columns(batch, 2, out, ["conv_id", "block", "c0", "c1", "before"])


def _carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    m0, m1 = MODULI
    for batch in batches:
        rows = zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True)
        yield _columns(batch, 1, [(pos + n, (c0 * p0 + h0) % m0, (c1 * p1 + h1) % m1) for pos, h0, h1, p0, p1, c0, c1, n in rows], ["conv_id", "pos", "h0", "h1"])


def _columns(batch: pa.RecordBatch, kept: int, rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    made = list(zip(*rows, strict=True)) if rows else [()] * (len(names) - kept)
    return pa.RecordBatch.from_arrays([*batch.columns[:kept], *(pa.array(c, pa.int64()) for c in made)], names)


def prefix_hashes(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv_id, pos, h0, h1): for each position the hash of the conversation up to it. turns: conv_id, turn, role, text, distinct."""
    kind = turns.schema["conv_id"].dataType.simpleString()
    dealt = turns.withColumn("block", F.coalesce(F.floor(F.col("turn") / block).cast("long"), F.lit(-(1 << 62))))
    in_order = dealt.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "turn", "role", "text")
    rolled = cut(in_order.select("conv_id", "block", "role", "text").mapInArrow(_roll, f"conv_id {kind}, block long, pos long, h0 long, h1 long, p0 long, p1 long"))
    totals = rolled.groupBy("conv_id", "block").agg(F.max_by(F.struct("pos", "h0", "h1", "p0", "p1"), "pos").alias("t")).select("conv_id", "block", "t.*")
    carry = totals.repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(_carry, f"conv_id {kind}, block long, c0 long, c1 long, before long")
    joined = rolled.join(carry, ["conv_id", "block"]).select("conv_id", "pos", "h0", "h1", "p0", "p1", "c0", "c1", "before")
    return joined.mapInArrow(_carried, f"conv_id {kind}, pos long, h0 long, h1 long")


def maximal(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv_id, n_turns) of the conversations that neither equal one with a smaller conv_id nor begin a longer one."""
    hashes = cut(prefix_hashes(turns, block))
    ends = hashes.groupBy("conv_id").agg(F.max_by(F.struct("pos", "h0", "h1"), "pos").alias("e")).select("conv_id", "e.*")
    first = ends.groupBy("pos", "h0", "h1").agg(F.min("conv_id").alias("conv_id"))
    inner = hashes.join(ends.select("conv_id", F.col("pos").alias("n")), "conv_id").filter("pos < n").select("pos", "h0", "h1").distinct()
    return first.join(inner, ["pos", "h0", "h1"], "left_anti").select("conv_id", F.col("pos").alias("n_turns"))


def collapse(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per maximal conversation: conv_id, n_turns, rendered."""
    turns = conversations.select("conv_id", "turn", "role", "text").filter("conv_id is not null").distinct()
    kept = turns.join(maximal(turns, block), "conv_id")
    in_order = F.array_sort(F.collect_list(F.struct(F.col("turn").isNotNull(), "turn", F.col("role").isNotNull(), "role", F.col("text").isNotNull(), "text")))
    part = lambda t: F.concat(F.lit("<|"), F.coalesce(t["role"], F.lit("")), F.lit("|>\n"), F.coalesce(t["text"], F.lit("")), F.lit("\n"))
    return kept.groupBy("conv_id", "n_turns").agg(in_order.alias("turns")).select("conv_id", "n_turns", F.array_join(F.transform("turns", part), "").alias("rendered"))


def digest(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_chars and the SHA-256 of each rendered maximal conversation."""
    return collapse(conversations).select("conv_id", "n_turns", F.length("rendered").cast("long").alias("n_chars"), F.sha2("rendered", 256).alias("rendered_sha256"))


ORACLE_SQL = r"""
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, count(*) AS n_turns,
        list(struct_pack(r := role, x := text) ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS turns,
        string_agg('<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || chr(10), ''
                   ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS rendered
      FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, CAST(length(rendered) AS BIGINT) AS n_chars, sha256(rendered) AS rendered_sha256
FROM c a
WHERE NOT EXISTS (SELECT 1 FROM c b WHERE b.n_turns > a.n_turns AND list_slice(b.turns, 1, a.n_turns) = a.turns)
  AND NOT EXISTS (SELECT 1 FROM c b WHERE b.n_turns = a.n_turns AND b.conv_id < a.conv_id AND b.turns = a.turns)
"""
