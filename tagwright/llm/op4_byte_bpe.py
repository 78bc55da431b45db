"""Byte-level BPE encoding and decoding from a rank file.

Each match of the splitting pattern is encoded by itself. A segment tree over its byte positions holds, for each live position,
the rank of the pair that starts there, and in each inner node the leftmost minimum below it. A merge takes the root's pair,
links the right part out, and updates the leaves of the merged part and of its live left neighbour, each in a logarithmic number
of steps. Short pieces run together, as rows of one array of trees; longer ones run one by one on a flat list. A piece that is
itself in the vocabulary is one token.

Null texts encode as empty (no ids, digests of the empty string). Ids may be null or repeated; rows stay as they are. Other columns
are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import slices

#: Units of text remembered with their ids by a worker; when full it starts anew.
REMEMBERED = 200_000
#: Pieces up to this many bytes are encoded together.
TOGETHER = 64
#: The pattern's pieces always start anew before white space that follows other characters, so texts may be cut there.
UNIT = re.compile(r"[^\S\x1c-\x1f]*[\S\x1c-\x1f]+|[^\S\x1c-\x1f]+")
_NONE = np.int64(1) << 40


class SegmentTreeBpe:
    """Encodes and decodes with the ranks of a file whose lines are a base64 token and its rank."""

    def __init__(self, path: str, pattern: str, remembered: int = REMEMBERED, most: int | None = None):
        """most: only so many of the first ranks, which are a vocabulary by themselves if they hold all bytes."""
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if most is None or int(b) < most}
        self.pieces = regex.compile(pattern).findall
        self.bytes_of = {str(i): t for t, i in self.ranks.items()}
        self.byte_ids = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)
        self.pairs = {(l, r): rank for t, rank in self.ranks.items() for k in range(1, len(t)) if (l := self.ranks.get(t[:k])) is not None and (r := self.ranks.get(t[k:])) is not None}
        self._make_table()
        self.known: dict[str, str] = {}
        self.remembered = remembered

    def _make_table(self) -> None:
        """Open addressing over (left << 32 | right); free slots hold -1."""
        keys = np.array([l << 32 | r for l, r in self.pairs], np.int64)
        values = np.fromiter(self.pairs.values(), np.int64, len(keys))
        self.bits = max(4, int(4 * len(keys)).bit_length())
        self.slot_key, self.slot_rank = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, _NONE, np.int64)
        left = np.arange(len(keys))
        at = self._slot(keys)
        while len(left):
            free = self.slot_key[at] < 0
            self.slot_key[at[free]] = keys[left[free]]
            won = self.slot_key[at] == keys[left]
            self.slot_rank[at[won]] = values[left[won]]
            left, at = left[~won], (at[~won] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << 32 | right
        at = self._slot(keys)
        found = self.slot_key[at]
        out = np.where(found == keys, self.slot_rank[at], _NONE)
        miss = np.flatnonzero((found != keys) & (found >= 0))
        while len(miss):
            at[miss] = (at[miss] + 1) & ((1 << self.bits) - 1)
            found = self.slot_key[at[miss]]
            hit = found == keys[miss]
            out[miss[hit]] = self.slot_rank[at[miss[hit]]]
            miss = miss[~hit & (found >= 0)]
        return out

    def _together(self, pieces: list[bytes], leaves: int) -> list[list[int]]:
        """Encode pieces of at most ``leaves`` bytes: a row of each array is one piece's tree and its linked live positions."""
        n = len(pieces)
        size = np.fromiter(map(len, pieces), np.int64, n)
        raw = np.frombuffer(b"".join(p.ljust(leaves, b"\0") for p in pieces), np.uint8).reshape(n, leaves)
        ids = self.byte_ids[raw]
        inside = np.arange(leaves) < size[:, None]
        nxt = np.broadcast_to(np.arange(1, leaves + 2), (n, leaves + 1)).copy()
        prv = np.broadcast_to(np.arange(-1, leaves), (n, leaves + 1)).copy()
        tree = np.full((n, 2 * leaves), _NONE << 7, np.int64)
        pair = self._pair_ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, leaves - 1)
        pair[~inside[:, 1:]] = _NONE
        tree[:, leaves : 2 * leaves - 1] = pair << 7 | np.arange(leaves - 1)
        for node in range(leaves - 1, 0, -1):
            np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1], out=tree[:, node])
        live = inside
        ended = _NONE << 7

        def update(rows: np.ndarray, at: np.ndarray, value: np.ndarray) -> None:
            node = at + leaves
            tree[rows, node] = value
            while (node := node >> 1)[0]:
                tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

        rows = np.flatnonzero(tree[:, 1] < ended)
        while len(rows):
            top = tree[rows, 1]
            at, rank = top & 127, top >> 7
            gone = nxt[rows, at]
            after = nxt[rows, gone]
            ids[rows, at] = rank
            live[rows, gone] = False
            nxt[rows, at] = after
            prv[rows, np.minimum(after, leaves)] = at
            update(rows, gone, np.full(len(rows), ended))
            has = after < size[rows]
            value = np.full(len(rows), ended)
            if has.any():
                r, a = rows[has], at[has]
                value[has] = self._pair_ranks(rank[has], ids[r, after[has]]) << 7 | a
            update(rows, at, value)
            before = prv[rows, at]
            has = before >= 0
            if has.any():
                r, b = rows[has], before[has]
                update(r, b, self._pair_ranks(ids[r, b], rank[has]) << 7 | b)
            rows = rows[tree[rows, 1] < ended]
        flat, counts = ids[live].tolist(), live.sum(1).tolist()
        out, k = [], 0
        for c in counts:
            out.append(flat[k : k + c])
            k += c
        return out

    def _alone(self, piece: bytes) -> list[int]:
        n, ids, none = len(piece), self.byte_ids[np.frombuffer(piece, np.uint8)].tolist(), (1 << 62, 0)
        leaves = 1 << (n - 1).bit_length()
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        tree = [none] * (2 * leaves)

        def value(a: int) -> tuple[int, int]:
            b = nxt[a]
            rank = self.pairs.get((ids[a], ids[b])) if b < n else None
            return none if rank is None else (rank, a)

        def update(a: int, v: tuple[int, int]) -> None:
            node = a + leaves
            tree[node] = v
            while node := node >> 1:
                tree[node] = min(tree[2 * node], tree[2 * node + 1])

        for a in range(n):
            tree[leaves + a] = value(a)
        for node in range(leaves - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])
        while tree[1] != none:
            rank, a = tree[1]
            gone = nxt[a]
            ids[a], ids[gone], nxt[a] = rank, -1, nxt[gone]
            if nxt[a] < n:
                prv[nxt[a]] = a
            update(gone, none)
            update(a, value(a))
            if prv[a] >= 0:
                update(prv[a], value(prv[a]))
        return [i for i in ids if i >= 0]

    def encode_pieces(self, pieces: list[bytes]) -> dict[bytes, list[int]]:
        out, by_size = {}, {}
        for p in pieces:
            if (rank := self.ranks.get(p)) is not None:
                out[p] = [rank]
            elif len(p) > TOGETHER:
                out[p] = self._alone(p)
            else:
                by_size.setdefault(max(4, 1 << (len(p) - 1).bit_length()), []).append(p)
        for leaves, some in by_size.items():
            for k in range(0, len(some), 8192):
                part = some[k : k + 8192]
                out.update(zip(part, self._together(part, leaves), strict=True))
        return out

    def learn(self, units: set[str]) -> None:
        """Encode units of text that aren't known yet."""
        new = list(units.difference(self.known))
        cut = [[p.encode("utf-8", "surrogatepass") for p in self.pieces(u)] for u in new]
        ids = {p: ",".join(map(str, x)) for p, x in self.encode_pieces(list(set().union(*cut))).items()} if cut else {}
        self.known.update((u, ",".join([ids[p] for p in c])) for u, c in zip(new, cut, strict=True))

    def encode_joined(self, texts: list[str]) -> list[str]:
        """The decimal ids of each text, joined by commas."""
        if len(self.known) > self.remembered:
            self.known.clear()
        cut = [UNIT.findall(t) for t in texts]
        self.learn(set().union(*cut))
        get = self.known.__getitem__
        return [",".join(map(get, u)) for u in cut]

    def encode(self, text: str) -> list[int]:
        joined = self.encode_joined([text])[0]
        return [int(x) for x in joined.split(",")] if joined else []

    def decode_joined(self, joined: str) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, joined.split(","))) if joined else b""

    def decode(self, ids: list[int]) -> bytes:
        return self.decode_joined(",".join(map(str, ids)))


_CODERS: dict[tuple[str, str], SegmentTreeBpe] = {}


def coder(path: str, pattern: str) -> SegmentTreeBpe:
    """The worker's coder for a rank file."""
    if (path, pattern) not in _CODERS:
        _CODERS[path, pattern] = SegmentTreeBpe(path, pattern)
    return _CODERS[path, pattern]


def byte_bpe(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per document: id, n_tokens, ids_sha256, decoded_sha256, and with_ids the token ids. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path, pattern)
        for whole in batches:
            for batch in slices(whole, most_chars=2_000_000):
                joined = bpe.encode_joined([t or "" for t in batch.column(1).to_pylist()])
                columns = [
                    batch.column(0),
                    pa.array([j.count(",") + 1 if j else 0 for j in joined], pa.int64()),
                    pa.array([hashlib.sha256(j.encode()).hexdigest() for j in joined], pa.string()),
                    pa.array([hashlib.sha256(bpe.decode_joined(j)).hexdigest() for j in joined], pa.string()),
                ]
                names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns.append(pa.array([[int(x) for x in j.split(",")] if j else [] for j in joined], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
