"""Fingerprints, Golay keys, links and components against brute force."""

import random

import numpy as np
import xxhash

from tagwright.llm import golay
from tagwright.llm.components import components
from tagwright.llm.op7_simhash import fingerprint, links, near_duplicates


def brute_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    for c in "\t\n\v\f\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    some = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in some]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints():
    rng = random.Random(5)
    for n in (0, 1, 2, 3, 4, 50):
        text = " ".join(rng.choice(["The", "É", "cat\tsat", "x\n", " ", "of"]) for _ in range(n))
        assert fingerprint(text.encode()) == brute_fingerprint(text)


def test_golay_keys_meet_within_two_bits():
    rng = np.random.default_rng(6)
    w = rng.integers(0, 1 << 23, 300)
    own = golay.keys(w)
    assert set((own >= 0).sum(1)) <= {1, 6}
    for a in range(23):
        assert (golay.decode(w ^ (1 << a))[:, None] == own).any(1).all()
        other = golay.keys(w ^ (1 << a) ^ (1 << (a + 5) % 23))
        assert all(set(x[x >= 0]) & set(y[y >= 0]) for x, y in zip(own, other, strict=True))


def closure(nodes, edges):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_links_equal_brute_force(spark):
    rng = random.Random(7)
    some = set()
    for _ in range(40):
        f = rng.getrandbits(64)
        for _ in range(12):
            g = f
            for _ in range(rng.randrange(6)):
                g ^= 1 << rng.randrange(64)
            some.add(g - (1 << 64) if g >> 63 else g)
    some |= {0, -1, 7, 15}
    want = {(a, b) for a in some for b in some if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 3}
    got = [tuple(r) for r in links(spark.createDataFrame([(x,) for x in some], "fp long")).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 300


def test_components_by_contraction_and_in_one_task(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 3000 + i) for i in range(50)] + [(5, 5)]
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    want = closure(nodes, [e for e in edges if e[0] != e[1]])
    for bound in (10**6, 20):
        got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long"), bound).collect()))
        assert set(got) == nodes
        assert {frozenset(n for n in nodes if got[n] == r) for r in set(got.values())} == {frozenset(n for n in nodes if want[n] == r) for r in set(want.values())}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_near_duplicates_on_odd_rows(spark):
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(400)]
    rows, base = [(0, None), (1, ""), (1, ""), (None, "x"), (2, " \t ")], [rng.choice(vocabulary) for _ in range(300)]
    for i in range(30):
        w = list(base)
        for _ in range(i % 4):
            w[rng.randrange(300)] = rng.choice(vocabulary)
        rows.append((10 + i, " ".join(w)))
    rows += [(100 + i, "word" + " other" * (i % 3)) for i in range(6)]
    df = spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id long, text string, fp int")
    got = [tuple(r) for r in near_duplicates(df).collect()]
    fps = {t: brute_fingerprint(t or "") for _, t in rows}
    root = closure(set(fps.values()), [(a, b) for a in fps.values() for b in fps.values() if (a ^ b).bit_count() <= 3])
    want = []
    for d, t in rows:
        ids = [e for e, u in rows if root[fps[u]] == root[fps[t]] and e is not None]
        want.append((d, f"{fps[t]:016x}", min(ids, default=None)))
    assert sorted(got, key=str) == sorted(want, key=str)
    assert near_duplicates(df.limit(0)).collect() == []
