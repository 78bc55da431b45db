"""SimHash near-duplicates found by Golay-code fuzzy hashing.

Fingerprints have 64 bits, cut into four segments of 16. Two fingerprints that differ in at most three bits agree in one segment at
least; of the other 48 bits, one half of 24 holds at most one error. So each fingerprint gives, for every choice of an exact segment
and a half, the key (choice, segment, index of the Golay codeword that the half's first 23 bits decode to); one side of the join
carries these keys, the other the keys of all decodings within one bit, and a link at distance three or less always meets. A pair is
kept only at its first choice, so each link comes out once, and is verified by its differing bits. The join is on distinct
fingerprints: copies never meet one another.

Null texts count as empty; texts without words have fingerprint zero and link like any other. Null ids keep a row and never
are a component id unless a component has no other. Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import golay
from .common import cut, slices, utf8, words_az
from .components import components

SHINGLE_WORDS, LINK_BITS, HASH_SEED = 3, 3, 42
#: The choices of an exact segment and a half of the rest, in the order in which a pair takes the first that holds.
CHOICES = [(i, j) for i in range(4) for j in range(2)]


def shingles(words: list[bytes], size: int) -> list[bytes]:
    """Space-joined runs of words, repeats included; fewer words: all of them as one; none: nothing."""
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[k:] for k in range(size)), strict=False)))


def majority(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half the hashes."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 65536):
        counts += np.unpackbits(hashes[k : k + 65536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def fingerprint(text: bytes, size: int = SHINGLE_WORDS, seed: int = HASH_SEED) -> int:
    """64-bit SimHash of a text's word shingles."""
    some = shingles(words_az(text), size)
    digest = xxhash.xxh64_intdigest
    return majority(np.fromiter((digest(s, seed) for s in some), np.uint64, len(some)))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE_WORDS) -> DataFrame:
    """(id, fingerprint as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                found = np.array([fingerprint(t, size) for t in utf8(batch.column(1))], np.uint64)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], [id_col, "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, fp long")


def _halves(i: int) -> list[int]:
    """The bits besides segment i, lowest first."""
    return [b for b in range(64) if b // 16 != i]


def _take(fp: np.ndarray, bits: list[int]) -> np.ndarray:
    out = np.zeros(len(fp), np.uint64)
    for s in range(0, len(bits), 1):
        out |= (fp >> np.uint64(bits[s]) & np.uint64(1)) << np.uint64(s)
    return out


def _choice_keys(fuzzy: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 20_000):
                signed = whole.column(0).slice(start, 20_000).to_numpy(zero_copy_only=False)
                fp = signed.view(np.uint64)
                for c, (i, j) in enumerate(CHOICES):
                    part = _take(fp, _halves(i)[24 * j : 24 * j + 23]).astype(np.int32)
                    index = golay.keys(part) if fuzzy else golay.decode(part)[:, None]
                    base = np.int64(c) << 28 | (fp >> np.uint64(16 * i) & np.uint64(0xFFFF)).astype(np.int64) << 12
                    key = base[:, None] | index
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(signed, index.shape[1])[index.ravel() >= 0]), pa.array(key.ravel()[index.ravel() >= 0])], ["fp", "key"])

    return run


def _mask(bits: list[int]) -> int:
    m = sum(1 << b for b in bits)
    return m - (1 << 64) if m >> 63 else m


def links(distinct: DataFrame) -> DataFrame:
    """All pairs (a, b) of the distinct signed fingerprints in column fp, a < b, that differ in at most three bits; each once."""
    left = distinct.select("fp").mapInArrow(_choice_keys(True), "a long, key long")
    right = distinct.select("fp").mapInArrow(_choice_keys(False), "b long, key long")
    differ = F.col("a").bitwiseXOR(F.col("b"))
    first = F.lit(None)
    for c, (i, j) in reversed(list(enumerate(CHOICES))):
        exact = differ.bitwiseAND(F.lit(_mask(list(range(16 * i, 16 * i + 16))))) == 0
        near = F.bit_count(differ.bitwiseAND(F.lit(_mask(_halves(i)[24 * j : 24 * j + 23])))) <= 1
        first = F.when(exact & near, c).otherwise(first)
    found = left.join(right, (left["key"] == right["key"]) & (F.col("a") < F.col("b")) & (F.bit_count(differ) <= LINK_BITS) & (F.shiftright(left["key"], 28) == first))
    return found.select("a", "b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, fingerprint (16 hex digits), component_id (the smallest id reachable over links)."""
    found = cut(fingerprints(docs, id_col, text_col))
    firsts = found.groupBy("fp").agg(F.min(id_col).alias("first"))
    roots = components(links(cut(firsts.select("fp"))))
    rooted = cut(firsts.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root")))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = rooted.join(least, "root").select("fp", "component_id")
    return found.join(classes, "fp").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
