"""The manifest against plain trees built whole, for blocks of several sizes."""

import hashlib
import random

import pytest

from tagwright.llm import op11_merkle as M

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sha(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(doc_id, text, lang, source, n_chars):
    return sha("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text))


def plain_tree(leaves):
    rows = [leaves]
    while len(rows[-1]) > 1:
        rows.append([sha(rows[-1][i : i + 3]) for i in range(0, len(rows[-1]), 3)])
    return rows


def plain_path(rows, at):
    for row in rows[:-1]:
        run = at // 3 * 3
        yield at - run, [x for i, x in enumerate(row[run : run + 3]) if run + i != at]
        at //= 3


def plain(docs):
    by_source = {}
    for d in docs:
        by_source.setdefault(d[3], []).append((d[0] is not None, d[0] or 0, plain_leaf(*d), d))
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: plain_tree([x[2] for x in sorted(by_source[s], key=lambda x: x[:3])]) for s in names}
    top = plain_tree([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for at, (_, _, leaf, d) in enumerate(sorted(by_source[s], key=lambda x: x[:3])):
            path = [*plain_path(trees[s], at), *plain_path(top, k)]
            found = plain_leaf(d[0], d[1].replace("\n", "") if d[1] is not None and __import__("zlib").crc32(str(d[0] if d[0] is not None else "").encode()) % 2 == 0 else d[1], *d[2:])
            value = found
            for i, siblings in path:
                value = sha([*siblings[:i], value, *siblings[i:]])
            out.append((d[0], s, leaf, trees[s][-1][0], top[-1][0], sha(x for _, run in path for x in run), value, value == top[-1][0]))
    return sorted(out, key=repr)


def result(frame, **more):
    return sorted((tuple(r) for r in M.manifest(frame, M.without_newlines(), **more).collect()), key=repr)


@pytest.mark.parametrize("levels", [1, 2, 6])
def test_against_plain_trees(spark, levels):
    rng = random.Random(7)
    docs = [(i, rng.choice(["a\nb", "", None, "x", "two\n\nlines"]), rng.choice(["en", None]), f"s{min(rng.randrange(9), 4)}", rng.choice([1, None])) for i in range(230)]
    docs += [(None, "null\nid", "en", "s0", 1), (None, None, None, None, None), (5, "again", "en", None, 2), (5, "again", "en", None, 2), (5, "other", "en", None, 2), (9, "é\n", "", "", 0)]
    frame = spark.createDataFrame(docs, SCHEMA).repartition(5)
    assert result(frame, block_levels=levels) == plain(docs)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 26, 27, 28, 60])
def test_traversal_of_each_size(n):
    leaves = [sha([str(i)]) for i in range(n)]
    rows, height = plain_tree(leaves), M.levels(n)
    assert M.block_root(leaves, height) == rows[-1][0]
    for i, path in enumerate(M.traverse(leaves, height)):
        assert path == list(plain_path(rows, i))
        assert M.folded(leaves[i], path) == rows[-1][0]


def test_stacks_stay_small():
    stack = M.Treehash(6)
    for i in range(3**6):
        stack.push(sha([str(i)]), False)
        assert all(len(x) < 3 for x in stack.level[:6])


def test_only_changed_rows_fail(spark):
    docs = [(i, "a\nb" if i % 3 else "ab", "en", "s", 3) for i in range(40)]
    rows = {r["doc_id"]: r for r in M.manifest(spark.createDataFrame(docs, SCHEMA), M.without_newlines()).collect()}
    from zlib import crc32

    assert {i for i, r in rows.items() if not r["verified"]} == {i for i in range(40) if i % 3 and crc32(str(i).encode()) % 2 == 0}
    assert all(r["verified"] for r in M.manifest(spark.createDataFrame(docs, SCHEMA)).collect())


def test_empty_table_and_clashing_names(spark):
    assert M.manifest(spark.createDataFrame([], SCHEMA), M.without_newlines()).collect() == []
    docs = [(i, f"t\n{i}", "en", "s", i) for i in range(8)]
    wide = spark.createDataFrame([(*d, "x", 1, "y", 2) for d in docs], SCHEMA + ", seen string, pos long, node string, total long")
    assert result(wide) == plain(docs)
