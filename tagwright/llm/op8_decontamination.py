"""Benchmark decontamination by a BM25 inverted index of the test items, searched with block-max WAND.

Index terms are pairs of neighbouring words of the items, so that everyday words alone retrieve nothing. Each different item text has an
entry for its whole and one for its question (all but the last sentence), so an item is found by its question however its answer is put.
An entry's impacts are BM25 weights divided by the entry's own score for itself, which makes one threshold fit all entries. An item of n
words is looked for in passages of 2 n words, each starting n / 2 words after the last (1 at least), so it lies whole within one even with
half as many words again between its own; other items, however long, change neither its passages nor its finds but by the corpus statistics.
Every document is searched whole. Entries are kept in classes of items of about one length, with block-max WAND over each class: stretches
of text that hold every passage of the class's items, and whose terms cannot reach the threshold even at their largest impacts, are
dismissed by sums over the whole batch; for the others it gives all entries that can reach it, and their passages are scored each. What is
retrieved is verified in its passage: by the share of the item's five-word shingles there, or of those of its question together with the
share of the words of its answer (the last sentence).

Items of the same text are one in the index, and all their ids are given. The index is broadcast in parts of at most ``INDEX_BYTES`` of
item text; more items make more passes over the documents. The number of texts, their mean length and the document frequencies are taken
over all items, whatever the parts, so scores and finds do not depend on them.

Null or empty texts and items without words match nothing; items shorter than five words are one shingle. Repeated rows give repeated
rows, equal items each their own row; null ids are kept. Other columns are ignored; an empty table on either side gives an empty result.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, slices, utf8, words_az
from .op7_simhash import shingles

TERM_WORDS, SHINGLE_WORDS = 2, 5
K1, B = 1.2, 0.75
#: Share of an item's own score that a passage must reach, and shares of shingles and answer words that verify it.
THRESHOLD, OVERLAP = 0.5, 0.8
#: Postings to a block; item text to a broadcast index.
BLOCK, INDEX_BYTES = 64, 32_000_000
#: Items' (hash, id) pairs that may be broadcast, 16 bytes each and a little more; a larger table is joined by a shuffle.
BROADCAST_ITEMS = 500_000
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


def question_and_answer(text: str) -> tuple[str, str]:
    """All sentences but the last, and the last; a single sentence is both."""
    parts = [p for p in _SENTENCE.split(text) if p.strip()]
    return (" ".join(parts[:-1]), parts[-1]) if len(parts) > 1 else (text, text)


def pairs(words: list[bytes]) -> Counter:
    """Pairs of neighbouring words; a text of one word has that word paired with the empty one, which no text holds."""
    return Counter(zip(words, words[1:], strict=False) if len(words) > 1 else [(w, b"") for w in words])


def passage_starts(n: int, low: int, high: int) -> range:
    """Where the passages of an item of n words start, from low on and before high."""
    step = max(1, n // 2)
    return range(-(-low // step) * step, high, step)


@dataclass
class Statistics:
    """Over the different texts of all items that have words: their number, mean number of pairs, and the numbers of texts that hold a
    pair, where that is not one."""

    n: int
    mean: float
    df: dict[tuple[bytes, bytes], int]

    @classmethod
    def of(cls, texts: list[str]) -> Statistics:
        words = [w for t in texts if (w := words_az(t.encode()))]
        sizes = [max(len(w) - 1, 1) for w in words]
        df = Counter(p for w in words for p in set(pairs(w)))
        return cls(len(words), sum(sizes) / max(len(words), 1), df)


class Postings:
    """Postings with block maxima of the entries of items of about one length, the longest of ``longest`` words."""

    def __init__(self, entries: list[tuple[int, dict[int, float]]], longest: int, terms: int, block: int):
        """entries: (item, impacts by term); terms: how many terms the whole index has."""
        self.block, self.longest = block, longest
        self.items = [item for item, _ in entries]
        self.impacts_of = [impacts for _, impacts in entries]
        raw: dict[int, list[tuple[int, float]]] = {}
        for e, (_, impacts) in enumerate(entries):
            for t, w in impacts.items():
                raw.setdefault(t, []).append((e, w))
        self.own = np.full(terms, -1, np.int64)  # the class's number of a term of the index
        self.own[list(raw)] = np.arange(len(raw))
        self.postings = [[e for e, _ in of] for of in raw.values()]
        self.impacts = [[w for _, w in of] for of in raw.values()]
        self.block_max = [[max(w[k : k + block]) for k in range(0, len(w), block)] for w in self.impacts]
        self.most = np.array([max(w) for w in self.block_max])

    def wand(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """All (entry, score) at or above the threshold for the distinct terms, by their numbers in the class."""
        lists = [[0, t] for t in terms]  # cursor, term
        out = []
        while True:
            lists = [x for x in lists if x[0] < len(self.postings[x[1]])]
            lists.sort(key=lambda x: self.postings[x[1]][x[0]])
            bound, pivot = 0.0, None
            for k, (_, t) in enumerate(lists):
                bound += self.most[t]
                if bound >= threshold - 1e-9:
                    pivot = k
                    break
            if pivot is None:
                return out
            item = self.postings[lists[pivot][1]][lists[pivot][0]]
            while pivot + 1 < len(lists) and self.postings[lists[pivot + 1][1]][lists[pivot + 1][0]] == item:
                pivot += 1
            blocks, ends = 0.0, []
            for c, t in lists[: pivot + 1]:
                post = self.postings[t]
                b = bisect_left(post, item, c) // self.block
                if b < len(self.block_max[t]):
                    blocks += self.block_max[t][b]
                    ends.append(post[min(len(post), (b + 1) * self.block) - 1] + 1)
                else:
                    ends.append(len(self.items))
            if blocks < threshold - 1e-9:  # no item before the nearest block end can reach it
                ahead = [self.postings[t][c] for c, t in lists[pivot + 1 : pivot + 2]]
                target = max(item + 1, min([*ends, *ahead]))
                for x in lists[: pivot + 1]:
                    x[0] = bisect_left(self.postings[x[1]], target, x[0])
                continue
            if self.postings[lists[0][1]][lists[0][0]] == item:
                score = math.fsum(self.impacts[t][c] for c, t in lists[: pivot + 1])
                for x in lists[: pivot + 1]:
                    x[0] += 1
                if score >= threshold - 1e-9:
                    out.append((item, score))
            else:
                for x in lists[: pivot + 1]:
                    x[0] = bisect_left(self.postings[x[1]], item, x[0])


class Index:
    """Different texts (key, text) as postings of word pairs, two entries to a text, its whole and its question, in classes by length."""

    def __init__(self, items: list[tuple[int, str]], block: int = BLOCK, statistics: Statistics | None = None):
        stats = statistics or Statistics.of([t for _, t in items])
        self.items = [(i, w, t) for i, t in items if (w := words_az(t.encode()))]
        self.vocabulary: dict[bytes, int] = {b"": 0}
        self.verify = []
        keys: dict[int, int] = {}
        entries: dict[int, list[tuple[int, dict[int, float]]]] = {}
        for k, (_, words, text) in enumerate(self.items):
            question, answer = (words_az(x.encode()) for x in question_and_answer(text))
            self.verify.append((set(shingles(words, SHINGLE_WORDS)), set(shingles(question, SHINGLE_WORDS)), set(answer)))
            for entry in [words] if question == words or not question else [words, question]:
                weights = self._weights(pairs(entry), stats)
                total = sum(weights.values())
                impacts = {}
                for (a, b), w in weights.items():
                    a, b = (self.vocabulary.setdefault(x, len(self.vocabulary)) for x in (a, b))
                    impacts[keys.setdefault(a << 32 | b, len(keys))] = w / total
                entries.setdefault(len(words).bit_length(), []).append((k, impacts))
        self.keys = np.array(sorted(keys), np.int64)
        self.term = np.array([keys[x] for x in self.keys.tolist()], np.int64)
        self.single = any(x & 0xFFFFFFFF == 0 for x in keys)
        self.classes = [Postings(of, max(len(self.items[k][1]) for k, _ in of), len(keys), block) for _, of in sorted(entries.items())]

    @staticmethod
    def _weights(terms: Counter, stats: Statistics) -> dict[tuple[bytes, bytes], float]:
        """BM25 weights of an entry's pairs."""
        size = sum(terms.values())
        out = {}
        for t, f in terms.items():
            df = stats.df.get(t, 1)
            out[t] = math.log(1 + (stats.n - df + 0.5) / (df + 0.5)) * f * (K1 + 1) / (f + K1 * (1 - B + B * size / stats.mean))
        return out

    def overlaps(self, item: int, passage: list[bytes]) -> tuple[float, float, float]:
        """Shares of the item's shingles, of its question's shingles and of its answer's words that the passage holds."""
        whole, question, answer = self.verify[item]
        sizes = {len(s.split(b" ")) for s in whole | question}
        have = set().union(*(map(b" ".join, zip(*(passage[k:] for k in range(n)), strict=False)) for n in sizes))
        words = set(passage)
        return len(whole & have) / len(whole), len(question & have) / len(question), len(answer & words) / len(answer)

    def search(self, texts: list[bytes], threshold: float) -> list[dict[int, tuple[float, float, float, float]]]:
        """For each text the verified items: the best passage's score and overlaps."""
        out: list[dict] = [{} for _ in texts]
        if not len(self.keys):
            return out
        cut = [words_az(t) for t in texts]
        sizes = np.fromiter(map(len, cut), np.int64, len(cut))
        starts = np.concatenate([[0], np.cumsum(sizes)])
        ids = np.fromiter(map(self.vocabulary.get, chain.from_iterable(cut), repeat(-1)), np.int64, int(starts[-1]))
        if not len(ids):
            return out
        right = np.concatenate([ids[1:], [-1]])
        right[starts[1:][sizes > 0] - 1] = -1  # no pair reaches into the next text
        ok = (ids >= 0) & (right >= 0)
        alone = np.flatnonzero(ids >= 0) if self.single else np.empty(0, np.int64)
        at = np.concatenate([np.flatnonzero(ok), alone])
        last = np.concatenate([at[: len(at) - len(alone)] + 1, alone])
        pair = np.concatenate([ids[ok] << 32 | right[ok], ids[alone] << 32])
        slot = np.searchsorted(self.keys, pair)
        hit = (slot < len(self.keys)) & (self.keys[np.minimum(slot, len(self.keys) - 1)] == pair)
        order = np.flatnonzero(hit)[np.argsort(at[hit], kind="stable")]
        at, last, term = at[order], last[order], self.term[slot[order]]
        for of in self.classes:
            own = of.own[term]
            here = own >= 0
            if here.any():
                self._search(of, cut, starts, at[here], last[here], term[here], own[here], threshold, out)
        return out

    def _search(self, of: Postings, cut: list, starts: np.ndarray, at: np.ndarray, last: np.ndarray, term: np.ndarray, own: np.ndarray, threshold: float, out: list[dict]) -> None:
        """The class's part of search. at, last, term, own: first and last word of each pair found, in order, and its numbers."""
        per = 2 * of.longest  # a passage that starts in a bin ends in it or in the next
        doc = np.searchsorted(starts, at, side="right") - 1
        bins = np.concatenate([[0], np.cumsum(np.diff(starts) // per + 2)])  # one spare bin, so that passages don't run into the next text
        where = bins[doc] + (at - starts[doc]) // per
        used, first = np.unique(where, return_index=True)
        mass = np.add.reduceat(of.most[own], first)
        near = np.concatenate([np.where(used[1:] == used[:-1] + 1, mass[1:], 0.0), [0.0]])
        # a passage may start in a bin that holds no pair of its own and have them all in the next one
        behind = used[mass >= threshold - 1e-9] - 1
        for b in np.union1d(used[mass + near >= threshold - 1e-9], behind[behind >= 0]).tolist():
            d = int(np.searchsorted(bins, b, side="right")) - 1
            low, high = np.searchsorted(where, [b, b + 2])
            terms = np.unique(own[low:high])
            lo = (b - int(bins[d])) * per
            if lo >= len(cut[d]) or of.most[terms].sum() < threshold - 1e-9:
                continue
            entries: dict[int, list[int]] = {}
            for e, _ in of.wand(terms.tolist(), threshold):
                entries.setdefault(of.items[e], []).append(e)
            base = int(starts[d])
            for item, mine in entries.items():
                n = len(self.items[item][1])
                for s in passage_starts(n, lo, min(lo + per, len(cut[d]))):
                    f, t = low + np.searchsorted(at[low:high], [base + s, base + s + 2 * n])
                    have = set(term[f:t][last[f:t] < base + s + 2 * n].tolist())
                    score = max(math.fsum(w for x, w in of.impacts_of[e].items() if x in have) for e in mine)
                    if score < threshold - 1e-9:
                        continue
                    whole, question, answer = self.overlaps(item, cut[d][s : s + 2 * n])
                    if whole >= OVERLAP or (question >= OVERLAP and answer >= OVERLAP):
                        best = out[d].get(item)
                        if best is None or (whole, score) > (best[1], best[0]):
                            out[d][item] = (score, whole, question, answer)


def _pair_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, 0):
            rows = [(a, b, part) for t, part in zip(utf8(batch.column(0)), batch.column(1).to_pylist(), strict=True) for a, b in pairs(words_az(t))]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(zip(*rows, strict=True) if rows else [()] * 3, (pa.binary(), pa.binary(), pa.int64()), strict=True)], ["a", "b", "part"])


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, 0):
            yield pa.RecordBatch.from_arrays([pa.array([len(words_az(t)) for t in utf8(batch.column(0))], pa.int64())], ["n"])


def indexes(benchmark: DataFrame, text_col: str = "text", index_bytes: int = INDEX_BYTES, block: int = BLOCK) -> list:
    """Broadcast indexes of parts of the items' different texts, each of about index_bytes of text at most; a text's key is its hash."""
    spark = benchmark.sparkSession
    texts = benchmark.select(F.col(text_col).alias("t")).filter("t is not null").distinct()
    total = texts.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    parts = max(1, -(-total // index_bytes))
    texts = cut(texts.select("t", F.xxhash64("t").alias("key"), F.pmod(F.xxhash64("t", F.lit(1)), F.lit(parts)).alias("part")))
    items = lambda k: [(r["key"], r["t"]) for r in texts.filter(F.col("part") == k).orderBy("t").collect()]
    if parts == 1:
        return [spark.sparkContext.broadcast(Index(items(0), block))]
    size = F.greatest(F.col("n") - 1, F.lit(1))
    n, mean = texts.select("t").mapInArrow(_sizes, "n long").filter("n > 0").agg(F.count("*"), F.avg(size)).first()
    df = cut(texts.select("t", "part").mapInArrow(_pair_rows, "a binary, b binary, part long").groupBy("a", "b").agg(F.count("*").alias("n"), F.collect_set("part").alias("parts")).filter("n > 1"))
    out = []
    for k in range(parts):
        own = df.filter(F.array_contains("parts", F.lit(k).cast("long"))).select("a", "b", "n").toArrow()
        of = {(a, b): m for a, b, m in zip(*(c.to_pylist() for c in own.columns), strict=True)}
        out.append(spark.sparkContext.broadcast(Index(items(k), block, Statistics(n, mean or 1.0, of))))
    return out


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """One row per document and verified item: id, item_id, score, item_overlap, question_overlap, answer_overlap. Documents are not shuffled."""
    kind = docs.schema[id_col].dataType.simpleString()
    found = None
    for index in indexes(benchmark, index_bytes=index_bytes):

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in slices(whole):
                    hits = index.value.search(utf8(batch.column(1)), threshold)
                    rows = [(d, index.value.items[i][0], *x) for d, of in enumerate(hits) for i, x in sorted(of.items())]
                    if rows:
                        columns = list(zip(*rows, strict=True))
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(columns[0], pa.int64())), pa.array(columns[1], pa.int64()), *(pa.array(c, pa.float64()) for c in columns[2:])], names)

        names = ["id", "key", "score", "item_overlap", "question_overlap", "answer_overlap"]
        part = docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, key long, score double, item_overlap double, question_overlap double, answer_overlap double")
        found = part if found is None else found.unionByName(part)
    ids = benchmark.filter(F.col("text").isNotNull()).select(F.col("item_id").alias("__item"), F.xxhash64("text").alias("key"))
    small = ids.limit(BROADCAST_ITEMS + 1).count() <= BROADCAST_ITEMS
    return found.join(F.broadcast(ids) if small else ids, "key").select(F.col("id").alias(id_col), F.col("__item").alias("item_id"), *names[2:])


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", threshold: float = THRESHOLD, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """The documents, with all their columns, that hold no verified item. Documents are not shuffled."""
    for index in indexes(benchmark, index_bytes=index_bytes):

        def run(batches: Iterator[pa.RecordBatch], index=index, at=docs.columns.index(text_col)) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in slices(whole, at):
                    hits = index.value.search(utf8(batch.column(at)), threshold)
                    yield batch.filter(pa.array([not h for h in hits], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
