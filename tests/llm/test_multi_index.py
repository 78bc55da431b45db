"""Recall against brute force, exact scores, odd vectors, hot cells."""

import numpy as np

from tagwright.llm import op5_multi_index as op5


def dot(v, w):
    total = 0.0
    for a, b in zip(v.tolist(), w.tolist()):
        total += a * b
    return total


def brute(rows, top=20, every=20):
    ok = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    out = {}
    for q, v in ok:
        if q % every == 0:
            s = [(-dot(v, w), i) for i, w in ok if i != q]
            out[q] = [(i, -s) for s, i in sorted(s)[:top]]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, rank int")


def collected(df):
    got = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert len(got[r["query_id"]]) == r["rank"]
    return got


def test_recall_and_exact_scores(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 16))
    x = centres[rng.integers(0, 12, 3000)] + 0.6 * rng.normal(size=(3000, 16))
    rows = [(i, v) for i, v in enumerate(x.astype(np.float32).tolist())]
    got, want = collected(op5.nearest(frame(spark, rows))), brute(rows)
    assert set(got) == set(want) and all(len(g) == 20 for g in got.values())
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.9
    vectors = {i: np.array(v, np.float32).astype(float) for i, v in rows}
    for q, found in got.items():
        for i, s in found:
            assert s == dot(vectors[q], vectors[i])


def test_walk_is_by_summed_distance():
    rng = np.random.default_rng(3)
    index = op5.MultiIndex(rng.normal(size=(800, 6)))
    q = rng.normal(size=6)
    cells = list(index.walk(q))
    a, b = (-(part[0] @ c.T) for part, c in zip(index.halves(q[None]), index.books))
    d = [a[c // len(b)] + b[c % len(b)] for c in cells]
    assert len(set(cells)) == len(cells) == len(a) * len(b) and np.all(np.diff(d) >= -1e-12)


def test_odd_vectors_and_few_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, [2.0, 1.0]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, []), (None, [1.0, 1.0]), (8, [2.0, 1.0]), (8, [2.0, 1.0]), (20, [-1.0, 0.5]), (40, [0.0, 0.0])]
    assert collected(op5.nearest(frame(spark, rows))) == {q: [x for x in dict.fromkeys(w)] for q, w in brute(rows).items()}
    assert op5.nearest(frame(spark, rows).limit(0)).collect() == []
    assert op5.nearest(frame(spark, [(2, None)])).collect() == []


def test_common_vectors_split_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(op5, "BLOCK", 64)
    monkeypatch.setattr(op5, "QUERIES", 7)
    rng = np.random.default_rng(4)
    rows = [(i, [1.0, 0.0, 0.5, 0.0]) for i in range(700)] + [(700 + i, v) for i, v in enumerate(rng.normal(size=(700, 4)).astype(np.float32).tolist())]
    got, want = collected(op5.nearest(frame(spark, rows))), brute(rows)
    assert set(got) == set(want)
    for q in range(0, 700, 20):
        assert [s for _, s in got[q]] == sorted((s for _, s in got[q]), reverse=True)
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.9
