"""The audit against a plain reading in whole numbers, for tiles of several sizes."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from tagwright.llm import op12_divergence as D

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def plain(docs, least, top):
    rows = [(d[2] or "", d[3] or "", TERM.findall((d[1] or "").translate(LOWER))) for d in docs]
    out = []
    for lang in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == lang]
        df = Counter(t for r in mine for t in set(r[2]))
        kept = sorted(t for t in df if df[t] >= least)
        share = lambda counts: {t: 1 + 10**9 * (counts[t] + 5) // (sum(counts[u] for u in kept) + 5 * len(kept)) for t in kept}
        counts = {s: Counter(t for r in mine if r[1] == s for t in r[2]) for s in {r[1] for r in mine}}
        p = {s: share(counts[s]) for s in counts}
        q = share(Counter(t for r in mine for t in r[2]))
        for s in counts:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in counts if o != s]
            own = [(p[s][t] - q[t], t) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", own)):
                found = sorted(found, key=lambda x: (-x[0], x[1].encode()))[: top if part == "term" else None]
                out += [(lang, s, part, item, value, k) for k, (value, item) in enumerate(found, 1)]
    return sorted(out)


def some_docs(n=160, sources=9):
    rng = random.Random(3)
    words = ["Alpha", "beta", "ÄÖ", "don't", "x1y", "été", "\U0001f600", "zeta", "under_score", "Q"]
    docs = [(i, " ".join(rng.choices(words, weights=range(1, 11), k=rng.randrange(12))), rng.choice(["en", "de", None]), f"s{min(rng.randrange(2 * sources), sources - 1)}", 1) for i in range(n)]
    return docs + [(None, None, "en", "silent", 0), (1, "", "en", None, 0), (1, "", "en", None, 0), (2, "12 34 -- !!", "xx", "a", 0), (3, None, "xx", "b", 0), (4, "solo", "yy", "only", 0)]


@pytest.mark.parametrize(("terms", "group_block", "top"), [(4096, 64, 50), (3, 4, 2), (1, 1, 1)])
def test_against_plain_reading(spark, terms, group_block, top):
    docs = some_docs()
    got = D.divergence(spark.createDataFrame(docs, SCHEMA).repartition(5), 8, top, terms, group_block)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(tuple(r) for r in got.collect()) == plain(docs, 8, top)


def test_parts_of_long_texts(monkeypatch):
    text = ("Wort-und_ÄÖ " * 400 + "x" * 3000 + " end").encode()
    whole = [t for part in D._terms(text) for t in part]
    monkeypatch.setattr(D, "PART", 17)
    assert [t for part in D._terms(text) for t in part] == whole == [t.encode() for t in TERM.findall(text.decode().translate(LOWER))]


def test_shares_are_exact_for_large_counts():
    rng = random.Random(1)
    for _ in range(200):
        n = rng.randrange(1, 8 * 10**15)
        c = rng.randrange(n)
        assert D.shares(np.array([c]), np.array([n + 35]))[0] == 1 + 10**9 * (c + 5) // (n + 35)


def test_pairs_in_parts():
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 10**9, (7, 11)), rng.integers(0, 10**9, (5, 11))
    assert (D.pair_sums(a, b, 1) == np.abs(a[:, None] - b[None]).sum(2)).all() and (D.pair_sums(a, b, 130) == D.pair_sums(a, b)).all()


def test_empty_table_and_clashing_names(spark):
    assert D.divergence(spark.createDataFrame([], SCHEMA)).collect() == []
    docs = some_docs(60)
    wide = spark.createDataFrame([(*d, 1, "t", 2, 3) for d in docs], SCHEMA + ", n long, term string, g int, block int")
    assert sorted(tuple(r) for r in D.divergence(wide, 8).collect()) == plain(docs, 8, 50)
