"""Snapshot collapse against comparing every pair of conversations."""

import hashlib
import random

from tagwright.llm.op10_snapshots import collapse, digest


def brute(rows):
    key = lambda v: (v is not None, v)
    convs = {}
    for c, t, r, x, *_ in set(rows):
        if c is not None:
            convs.setdefault(c, []).append((key(t), key(r), key(x)))
    convs = {c: sorted(v) for c, v in convs.items()}
    parts = {c: [(r, x) for _, r, x in v] for c, v in convs.items()}
    out = {}
    for c, p in parts.items():
        if any((len(q) > len(p) and q[: len(p)] == p) or (q == p and d < c) for d, q in parts.items() if d != c):
            continue
        out[c] = "".join(f"<|{r[1] or ''}|>\n{x[1] or ''}\n" for r, x in p)
    return out, parts


def test_collapse_equals_brute_force(spark):
    rng = random.Random(2)
    rows = []
    for c in range(60):
        base = random.Random(c % 7)
        for t in range(rng.randrange(1, 9)):
            rows.append((c, t, ["user", "assistant"][t % 2], f"said {base.randrange(3)} é", 1))
    rows += [(100, None, None, None, 1), (101, None, None, "", 1), (102, 0, "user", "x", 1), (102, 0, "user", "x", 1), (102, 0, "user", "x", 2), (102, 0, "tool", "x", 1), (None, 0, "user", "x", 1), (103, -5, "tool", "x", 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, pos int")
    want, parts = brute([r[:4] for r in rows])
    for block in (4096, 3):
        got = {r["conv_id"]: (r["n_turns"], r["rendered"]) for r in collapse(df, block).collect()}
        assert got == {c: (len(parts[c]), t) for c, t in want.items()}
    assert {r["conv_id"]: r["rendered_sha256"] for r in digest(df).collect()} == {c: hashlib.sha256(t.encode()).hexdigest() for c, t in want.items()}
    assert collapse(df.limit(0)).collect() == []
