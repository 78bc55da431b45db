"""Toxicity by class-conditional Kneser-Ney models.

Two interpolated Kneser-Ney models over the characters of words (n-grams up to six, words marked at both ends) are counted, one
from toxic and one from ordinary training documents. Each class has its own counts at the highest order only; below it both share
one model of continuation counts, so an expression too rare to have been seen in a class falls back on what is known of its parts.
A word's log-likelihood ratio is remembered by a task, so a repeated word is scored once. A document is compared by its
length-normalised ratio, over the whole text and over its best windows of 1, 8 and 32 words; a logistic regression on
cross-fitted documents turns these into a score between 0 and 1.

Labels are learned from at most ``MOST_PER_CLASS`` (toxic) and twice as many (ordinary) labelled documents, those with the least
hashes of their ids, and of each class from those that together with the ones before stay within ``MOST_BYTES`` of text (longer ones are
passed over); whole texts of them all. The models that score are counted on all of the sample; only the regression is fitted on documents
that the models it sees were not counted on. Every document is scored, over its whole text.

Null texts count as empty and score like any text without words. A null id counts as the text '' when rows are dealt into training
and held-out ones. Of several labels of one id the largest holds, of several texts the least is learned from; null labels are no labels. Without a labelled example of a class the
score is the other class's: 0 without toxic examples, 1 without ordinary ones. Other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import math
import pickle
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, cut, slices, utf8, words_az

#: Bounds of the labelled sample: toxic documents, and half the ordinary ones; bytes of text of a class.
MOST_PER_CLASS, MOST_BYTES = 2000, 64_000_000
ORDER, WINDOWS, FOLDS = 6, (1, 8, 32), 5
#: With fewer toxic documents every fold is cross-fitted in turn, else the first alone.
FEW = 250
#: Words remembered by a task; when full it starts anew. Longer words are scored in pieces of this many characters.
REMEMBERED, LONGEST = 300_000, 64


def grams(word: str) -> list[str]:
    """Each character of a marked word with up to five before it."""
    out = []
    for k in range(0, max(len(word), 1), LONGEST):
        p = f"\x02{word[k : k + LONGEST]}\x03"
        out += [p[max(0, i - ORDER + 1) : i + 1] for i in range(1, len(p))]
    return out


def _discount(counts) -> float:
    of = Counter(counts)
    return of[1] / (of[1] + 2 * of[2]) if of[1] else 0.5


class Ratios:
    """Log-likelihood ratios, toxic to ordinary, from counts of grams by class."""

    def __init__(self, toxic: dict[str, int], ordinary: dict[str, int]):
        parts: set[str] = set()
        for k in chain(toxic, ordinary):
            while k and k not in parts:  # the ends of a known part are known
                parts.add(k)
                k = k[1:]
        lower = Counter(k[1:] for k in parts if len(k) > 1)  # continuation counts: how many different characters come before a shorter gram
        del parts
        total, types = self._contexts(lower)
        d = _discount(lower.values())
        known: dict[str, float] = {"": 1 / max(1, types.get("", 1))}

        def shared(k: str) -> float:
            if k not in known:
                c, down = k[:-1], shared(k[1:])
                known[k] = (max(lower.get(k, 0) - d, 0) + d * types[c] * down) / total[c] if c in total else down
            return known[k]

        classes = [(g, *self._contexts(g), _discount(g.values())) for g in (toxic, ordinary)]

        def of(k: str, g: dict, total: dict, types: dict, d: float) -> float:
            c, down = k[:-1], shared(k[1:])
            return (max(g.get(k, 0) - d, 0) + d * types[c] * down) / total[c] if c in total else down

        self.seen = {k: math.log(of(k, *classes[0]) / of(k, *classes[1])) for k in set(toxic) | set(ordinary)}
        weight = lambda c, g, total, types, d: d * types[c] / total[c] if c in total else 1.0
        self.backoff = {c: r for c in set(classes[0][1]) | set(classes[1][1]) if (r := math.log(weight(c, *classes[0]) / weight(c, *classes[1])))}
        self.known: dict[bytes, float] = {}

    @staticmethod
    def _contexts(counts: dict[str, int]) -> tuple[dict[str, int], dict[str, int]]:
        total: Counter = Counter()
        types: Counter = Counter()
        for k, n in counts.items():
            total[k[:-1]] += n
            types[k[:-1]] += 1
        return dict(total), dict(types)

    def word(self, word: str) -> float:
        ratio, seen, backoff = 0.0, self.seen, self.backoff
        for k in grams(word):
            r = seen.get(k)
            ratio += backoff.get(k[:-1], 0.0) if r is None else r
        return ratio

    def features(self, text: bytes) -> list[float]:
        """The length-normalised ratio of the whole text, of its best windows, of its best three words, and the log of its length."""
        words = words_az(text)
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        for w in set(words).difference(known):
            known[w] = self.word(w.decode())
        r = np.fromiter(map(known.__getitem__, words), np.float64, len(words)) if words else np.zeros(1)
        sums = np.concatenate([[0.0], np.cumsum(r)])
        best = [float(((sums[k:] - sums[:-k]) / k).max()) for k in (min(w, len(r)) for w in WINDOWS)]
        top = np.partition(r, len(r) - min(3, len(r)))[-3:]
        return [float(r.mean()), *best, float(top.mean()), math.log(len(r))]


def _build(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    toxic: dict[str, int] = {}
    ordinary: dict[str, int] = {}
    for f in frames:
        for of, name in ((toxic, "toxic"), (ordinary, "ordinary")):
            of.update((g, n) for g, n in zip(f["gram"], f[name].tolist(), strict=True) if n)
    yield pd.DataFrame({"model": [pickle.dumps(Ratios(toxic, ordinary))]})


class Logistic:
    """Ridge logistic regression by Newton's method on standardised features."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 1e-2):
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-9
        z = self._put(x)
        self.w = np.zeros(z.shape[1])
        for _ in range(60):
            p = self._squash(z @ self.w)
            hessian = (z * (p * (1 - p) + 1e-6)[:, None]).T @ z + ridge * np.eye(len(self.w))
            step = np.linalg.solve(hessian, z.T @ (p - y) + ridge * self.w)
            self.w -= step
            if np.abs(step).max() < 1e-8:
                break

    def _put(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([(x - self.mean) / self.scale, np.ones((len(x), 1))], 1)

    @staticmethod
    def _squash(v: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(v, -35, 35)))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self._squash(self._put(x) @ self.w)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, fold, toxic, n) summed over the words of a task's documents."""
    words: dict[tuple[int, int], Counter] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for (fold, toxic), of in words.items():
            n: Counter = Counter()
            for w, k in of.items():
                for g in grams(w.decode()):
                    n[g] += k
            if n:
                yield pa.RecordBatch.from_arrays([pa.array(list(n)), pa.array([fold] * len(n), pa.int32()), pa.array([toxic] * len(n), pa.int32()), pa.array(list(n.values()), pa.int64())], ["gram", "fold", "toxic", "n"])
        words.clear()

    for whole in batches:
        for batch in slices(whole, 0):
            for text, fold, toxic in zip(utf8(batch.column(0)), *(c.to_pylist() for c in batch.columns[1:]), strict=True):
                words.setdefault((fold, toxic), Counter()).update(words_az(text))
            if sum(map(len, words.values())) > REMEMBERED:
                yield from out()
    yield from out()


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, most: int, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(text, fold, toxic) of a bounded sample of the labelled training rows, dealt into folds."""
    fit = labels.filter(F.col("toxic").isNotNull() & (crc_mod(F.col(id_col), 5) != 0)).groupBy(id_col).agg(F.max("toxic").cast("int").alias("toxic"))
    fit = fit.select(id_col, "toxic", F.floor(crc_mod(F.col(id_col), 5 * FOLDS) / 5).cast("int").alias("fold"))
    by_hash = [F.xxhash64(F.col(id_col).cast("string")), F.col(id_col)]
    ids = fit.filter("toxic = 1").orderBy(*by_hash).limit(most).union(fit.filter("toxic = 0").orderBy(*by_hash).limit(2 * most))
    one = docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(ids), id_col).groupBy(id_col, "fold", "toxic").agg(F.min("text").alias("text"))
    found = cut(one.withColumns({"size": F.octet_length("text"), "key": F.xxhash64(F.col(id_col).cast("string"))}))
    left, keys = {0: most_bytes, 1: most_bytes}, []
    for r in found.select("toxic", "key", "size").orderBy("key").collect():  # a row for each document of the bounded sample
        if r["size"] <= left[r["toxic"]]:
            left[r["toxic"]] -= r["size"]
            keys.append((r["key"],))
    return found.join(F.broadcast(docs.sparkSession.createDataFrame(keys, "key long")), "key").select("text", "fold", "toxic")


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST_PER_CLASS) -> tuple[bytes | None, Logistic | float]:
    """The packed ratios and the calibration; without examples of both classes a constant score."""
    spark = docs.sparkSession
    sample = cut(labelled_sample(docs, labels, id_col, text_col, most))
    sizes = {(r["fold"], r["toxic"]): r["n"] for r in sample.groupBy("fold", "toxic").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_ordinary = (sum(n for (_, t), n in sizes.items() if t == k) for k in (1, 0))
    if not n_toxic or not n_ordinary:
        return None, float(n_toxic > 0)
    counted = cut(sample.mapInArrow(_count, "gram string, fold int, toxic int, n long").groupBy("gram", "fold", "toxic").agg(F.sum("n").alias("n")))

    def ratios(without: int) -> bytes:
        """Built in one task from the bounded sample's grams; the driver sees the finished tables only, as bytes."""
        of = lambda toxic: F.sum(F.when(F.col("toxic") == toxic, F.col("n")).otherwise(0))
        kept = counted.filter(F.col("fold") != without).groupBy("gram").agg(of(1).alias("toxic"), of(0).alias("ordinary"))
        return bytes(kept.coalesce(1).mapInPandas(_build, "model binary").first()[0])

    x, y = [], []
    for f in range(FOLDS) if n_toxic < FEW else range(1):
        if not all(any(sizes.get((g, t)) for g in range(FOLDS) if g != f) for t in (0, 1)):
            continue
        model = spark.sparkContext.broadcast(ratios(f))

        def features(batches: Iterator[pa.RecordBatch], model=model) -> Iterator[pa.RecordBatch]:
            held = pickle.loads(model.value)
            for whole in batches:
                for batch in slices(whole, 0):
                    yield pa.RecordBatch.from_arrays([pa.array([held.features(t) for t in utf8(batch.column(0))], pa.list_(pa.float64())), batch.column(1)], ["x", "toxic"])

        for r in sample.filter(F.col("fold") == f).select("text", "toxic").mapInArrow(features, "x array<double>, toxic int").collect():
            x.append(r["x"])
            y.append(r["toxic"])
        model.unpersist()
    if len(set(y)) < 2:
        return None, float(n_toxic > n_ordinary)
    return ratios(-1), Logistic(np.array(x), np.array(y, float))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST_PER_CLASS, keep: list[str] | None = None) -> DataFrame:
    """One row per document: id, held_out, score, predicted; or, with keep, the named columns (the text among them) and __score."""
    ratios, calibration = learn(docs, labels, id_col, text_col, most)
    model = docs.sparkSession.sparkContext.broadcast((ratios, calibration))
    carried = [c for c in (keep if keep is not None else [id_col]) if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed, calibration = model.value
        ratios = packed and pickle.loads(packed)  # for this task only: a worker goes on to other stages
        for whole in batches:
            for batch in slices(whole, len(carried)):
                if ratios is None:
                    score = np.full(batch.num_rows, calibration)
                else:
                    score = calibration(np.array([ratios.features(t) for t in utf8(batch.column(len(carried)))]))
                yield pa.RecordBatch.from_arrays([*(batch.columns if keep else batch.columns[:-1]), pa.array(score, pa.float64())], [*names, *["__text"] * bool(keep), "__score"])

    names = [f"__c{k}" for k in range(len(carried))]
    schema = ", ".join([*(f"{n} {docs.schema[c].dataType.simpleString()}" for n, c in zip(names, carried, strict=True)), *["__text string"] * bool(keep), "__score double"])
    scored = docs.select(*(F.col(c).alias(n) for n, c in zip(names, carried, strict=True)), F.col(text_col).alias("__text")).mapInArrow(run, schema)
    if keep:
        of = dict(zip([*carried, text_col], [*names, "__text"], strict=True))
        return scored.select(*(F.col(of[c]).alias(c) for c in keep), F.col("__score"))
    return scored.select(F.col(names[0]).alias(id_col), (crc_mod(F.col(names[0]), 5) == 0).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= 0.5).cast("int").alias("predicted"))
