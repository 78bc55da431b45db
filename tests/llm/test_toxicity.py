"""Kneser-Ney ratios against direct probabilities, held-out accuracy, odd rows."""

import math
import pickle
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tagwright.llm.op9_toxicity import Ratios, grams, labelled_sample, learn, toxicity


def test_class_models_are_distributions():
    toxic, ordinary = {"\x02a": 3, "\x02b": 1, "\x02ab": 2}, {"\x02a": 1, "\x02c": 2}
    r = Ratios(toxic, ordinary)
    assert r.seen["\x02b"] > 0 > r.seen["\x02c"]
    assert r.word("b") > 0 > r.word("c")


def kneser_ney(words, context, char, toxic):
    """P(char | context) in a class by the formulas, from the words of both classes (word, class), counted anew for each value."""
    marked = [("\x02" + w + "\x03", c) for w, c in words]
    windows = [(w[max(0, i - 5) : i], w[i], c) for w, c in marked for i in range(1, len(w))]
    kinds = {(h[k:], x) for h, x, _ in windows for k in range(len(h) + 1)}
    before = {}  # different characters before a context and its character
    for h, x in kinds:
        if h:
            before.setdefault((h[1:], x), set()).add(h[0])
    lower = {k: len(v) for k, v in before.items()}

    def discount(counts):
        ones, twos = counts.count(1), counts.count(2)
        return ones / (ones + 2 * twos) if ones else 0.5

    d = discount(list(lower.values()))

    def shared(h, x):
        of = {y: n for (g, y), n in lower.items() if g == h}
        down = shared(h[1:], x) if h else 1 / len(of)
        return (max(of.get(x, 0) - d, 0) + d * len(of) * down) / sum(of.values()) if of else down

    counts = {}
    for h, x, c in windows:
        if c == toxic:
            counts[h, x] = counts.get((h, x), 0) + 1
    own = discount(list(counts.values()))
    of = {y: n for (g, y), n in counts.items() if g == context}
    down = shared(context[1:], char)
    return (max(of.get(char, 0) - own, 0) + own * len(of) * down) / sum(of.values()) if of else down


def test_ratios_equal_the_formulas():
    rng = random.Random(2)
    words = [("".join(rng.choice("abc") for _ in range(rng.randrange(1, 9))), rng.randrange(2)) for _ in range(60)]
    counts = {0: {}, 1: {}}
    for w, c in words:
        for g in grams(w):
            counts[c][g] = counts[c].get(g, 0) + 1
    r = Ratios(counts[1], counts[0])
    contexts = {g[:-1] for g in counts[0]}
    for c in rng.sample(sorted(contexts), 8):
        assert abs(sum(kneser_ney(words, c, x, 1) for x in "abc\x03") - 1) < 1e-9
    for w in [words[0][0], words[1][0], "abcabcabc", "cccc", "a", "acbbca"]:
        p = [(g[:-1], g[-1]) for g in grams(w)]
        want = sum(math.log(kneser_ney(words, c, x, 1) / kneser_ney(words, c, x, 0)) for c, x in p)
        assert abs(r.word(w) - want) < 1e-9, w


def test_grams():
    assert grams("ab") == ["\x02a", "\x02ab", "\x02ab\x03"] and grams("") == ["\x02\x03"]
    assert len(grams("x" * 200)) == 200 + 4


def corpus(n=900, seed=3):
    rng = random.Random(seed)
    parts = ["the", "of", "an", "er", "ing", "tion", "sto", "re", "mo"]
    docs, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(3, 200))]
        toxic = i % 5 == 1
        if toxic:
            for _ in range(2):
                words[rng.randrange(len(words))] = "zuk" + rng.choice(parts) + rng.choice(parts)
        docs.append((i, " ".join(words), "x", 0.5))
        labels.append((i, None if i % 11 == 0 else int(toxic), 1))
    return docs, labels


def test_held_out_accuracy_and_odd_rows(spark):
    docs, labels = corpus()
    docs += [(5000, None, "x", 0.5), (5001, "", "x", 0.5), (None, "the of", "x", 0.5), (1, docs[1][1], "x", 0.5)]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, score double")
    t = spark.createDataFrame(labels + [(1, 0, 1)], "doc_id long, toxic int, lang int")
    got = toxicity(d, t).collect()
    assert len(got) == len(docs) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"] if r["doc_id"] is not None else "").encode()) % 5 == 0) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 5000]
    assert sum(r["predicted"] == (r["doc_id"] % 5 == 1) for r in held) / len(held) > 0.97
    assert toxicity(d.limit(0), t).collect() == []


def test_every_label_counts_and_bytes_are_bounded(spark):
    docs, labels = corpus(2000)
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, score double")
    t = spark.createDataFrame(labels, "doc_id long, toxic int, lang int")
    packed, _ = learn(d, t)
    train = {i: int(x) for i, x, _ in labels if x is not None and zlib.crc32(str(i).encode()) % 5}
    seen = {g for i, text, *_ in docs if i in train for w in text.split() for g in grams(w)}
    assert set(pickle.loads(packed).seen) == seen and sum(train.values()) > 250
    sample = labelled_sample(d, t, "doc_id", "text", 2000, 20_000)
    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.sum(F.octet_length("text")).alias("n")).collect()}
    assert set(sizes) == {0, 1} and all(18_000 < n <= 20_000 for n in sizes.values())


def test_without_labels_of_a_class(spark):
    d = spark.createDataFrame([(i, "a b") for i in range(20)], "doc_id long, text string")
    for toxic, score in ((0, 0.0), (1, 1.0)):
        t = spark.createDataFrame([(i, toxic) for i in range(20)], "doc_id long, toxic int")
        assert {r["score"] for r in toxicity(d, t).collect()} == {score}
    assert {r["score"] for r in toxicity(d, t.limit(0)).collect()} == {0.0}


@pytest.mark.parametrize("n", [30])
def test_few_documents(spark, n):
    docs, labels = corpus(n)
    got = toxicity(spark.createDataFrame(docs, "doc_id long, text string, lang string, score double"), spark.createDataFrame(labels, "doc_id long, toxic int, lang int")).collect()
    assert len(got) == n and not any(math.isnan(r["score"]) for r in got)
