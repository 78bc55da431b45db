"""Block-max WAND and verification against scoring every passage with every item."""

import math
import random
import re

from tagwright.llm import op8_decontamination as op8
from tagwright.llm.common import words_az


def corpus(seed=1):
    rng = random.Random(seed)
    words = ["".join(rng.choice(["th", "er", "on", "an", "re"]) for _ in range(rng.randrange(1, 4))) for _ in range(120)]
    sentence = lambda n: " ".join(rng.choice(words) for _ in range(n)).capitalize() + "."
    items = [(i, " ".join(sentence(rng.randrange(3, 15)) for _ in range(rng.randrange(1, 5)))) for i in range(150)]
    items += [(500, items[3][1]), (501, "Word"), (502, ""), (503, None), (None, sentence(9))]
    docs = []
    for d in range(150):
        parts = [sentence(rng.randrange(3, 60)) for _ in range(rng.randrange(1, 6))]
        if d % 5 == 0:
            parts.insert(rng.randrange(len(parts) + 1), items[d][1])
        if d % 7 == 0:
            t = items[d % 150][1].split(" ")
            t[rng.randrange(len(t))] = "changed"
            parts.insert(0, " ".join(t))
        docs.append((d, " ".join(parts), "x"))
    return docs + [(900, None, "x"), (901, "", "x"), (None, items[0][1], "x"), (902, "a word of it", "x")], items


def brute(docs, items):
    """BM25 over word pairs from its formula, every passage of every item against its whole and its question, nothing skipped.
    Passages: twice the item's words, from every multiple of half of them."""
    words = lambda t: words_az((t or "").encode())
    bigrams = lambda w: [*zip(w, w[1:])] if len(w) > 1 else [(x, "") for x in w]
    texts = sorted({t for _, t in items if words(t)})
    n, sizes = len(texts), [len(bigrams(words(t))) for t in texts]
    mean = sum(sizes) / n
    df = {}
    for t in texts:
        for p in set(bigrams(words(t))):
            df[p] = df.get(p, 0) + 1

    def weights(entry):
        own = bigrams(entry)
        f = {p: own.count(p) for p in own}
        return {p: math.log(1 + (n - df[p] + 0.5) / (df[p] + 0.5)) * k * 2.2 / (k + 1.2 * (0.25 + 0.75 * len(own) / mean)) for p, k in f.items()}

    def five(w):
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}

    known = []
    for t in texts:
        parts = [x for x in re.split(r"(?<=[.!?])\s+|\n+", t) if x.strip()]
        question, answer = (" ".join(parts[:-1]), parts[-1]) if len(parts) > 1 else (t, t)
        known.append((words(t), words(question), set(words(answer)), [weights(words(t)), weights(words(question))], [i for i, x in items if x == t]))
    out = []
    for d, text, _ in docs:
        w, hits = words(text), set()
        for k, (own, question, answer, entries, _) in enumerate(known):
            for lo in range(0, len(w), max(1, len(own) // 2)):
                passage = w[lo : lo + 2 * len(own)]
                have = {*zip(passage, passage[1:]), *((x, "") for x in passage)}
                if any(sum(x for p, x in e.items() if p in have) >= (op8.THRESHOLD - 1e-9) * sum(e.values()) for e in entries):
                    grams = {m: {*zip(*(passage[j:] for j in range(m)))} for m in range(1, 6)}  # noqa: B023
                    held = lambda s: len([x for x in five(s) if x in grams[len(x)]]) / len(five(s))  # noqa: B023, E731
                    if held(own) >= 0.8 or (held(question) >= 0.8 and len(answer & set(passage)) >= 0.8 * len(answer)):
                        hits.add(k)
        out += [(d, i) for k in hits for i in known[k][4]]
    return sorted(out, key=str)


def test_small_blocks_find_the_same():
    docs, items = corpus(2)
    some = [(i, t) for i, t in items if t]
    texts = [(t or "").encode() for _, t, _ in docs]
    assert op8.Index(some, 2).search(texts, 0.3) == op8.Index(some).search(texts, 0.3) != [{}] * len(texts)


def test_leaks_equal_brute_force_whatever_the_parts(spark):
    docs, items = corpus()
    d, b = spark.createDataFrame(docs, "doc_id long, text string, item_id string"), spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    got = {}
    for parts, size in ((1, op8.INDEX_BYTES), (8, 2000)):
        assert (len(op8.indexes(b, index_bytes=size)) > 4) == (parts > 1)
        got[parts] = sorted(((r["doc_id"], r["item_id"], round(r["score"], 9)) for r in op8.leaks(d, b, index_bytes=size).collect()), key=str)
        assert sorted((x[:2] for x in got[parts]), key=str) == want
    assert got[1] == got[8] and len(want) >= 30
    assert {(i, i) for i in range(0, 150, 5)} <= set(want) and (None, 0) in want and (15, 500) not in want and (902, 501) in want
    kept = [r["doc_id"] for r in op8.clean(d, b).collect()]
    assert sorted(kept, key=str) == sorted((x[0] for x in docs if x[0] not in {w[0] for w in want}), key=str) and op8.clean(d, b).columns == d.columns
    assert op8.leaks(d.limit(0), b).collect() == [] == op8.leaks(d, b.limit(0)).collect()


def test_an_item_is_found_by_its_question_however_the_answer_is_put(spark):
    rng = random.Random(6)
    _, items = corpus()
    some = [(i, t) for i, t in items if t and t.count(". ") >= 1 and i is not None][:60]
    docs = []
    for i, t in some:
        question, answer = op8.question_and_answer(t)
        mixed = answer.split(" ")
        rng.shuffle(mixed)
        docs.append((i, question + " filler between " + " ".join(mixed)))
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(some, "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in op8.leaks(d, b).collect()}
    assert {(i, i) for i, _ in docs} <= found


def test_equal_items_each_have_their_row(spark):
    items = [(i, "what is the name of this river and where does it end? in the sea") for i in range(40)] + [(None, "another text of some words here")]
    b = spark.createDataFrame(items, "item_id long, text string")
    d = spark.createDataFrame([(1, "so " + items[0][1] + " indeed")], "doc_id long, text string")
    assert sorted(r["item_id"] for r in op8.leaks(d, b).collect()) == list(range(40))
    assert sorted(r["item_id"] for r in op8.leaks(d, b, index_bytes=20).collect()) == list(range(40))


def test_a_long_item_changes_no_other_items_finds(spark):
    """Answer words spread over a thousand words are no find of a short item, with or without a long item beside it."""
    rng = random.Random(9)
    _, items = corpus()
    some = [(i, t) for i, t in items if t and i is not None and len(t.split()) >= 20][:50]
    question = "Which of the seven bridges over the upper river was the first to be built by the town itself?"
    answer = "Its oldest stone arch stands behind mill lane near saint olaf market"
    some.append((700, question + " " + answer))
    filler = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    far = question + " " + " ".join(w + " " + filler(80) for w in answer.split(" "))
    near = question + " " + filler(5) + " " + answer
    docs = [(1, far), (2, filler(333) + " " + near + " " + filler(50)), *((1000 + i, filler(7) + " " + t + " " + filler(900)) for i, t in some[:20])]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    found = []
    for extra in ([], [(800, filler(3000) + ".")]):
        b = spark.createDataFrame(some + extra, "item_id long, text string")
        found.append({(r["doc_id"], r["item_id"]) for r in op8.leaks(d, b).collect()})
        assert found[-1] == set(brute([(i, t, "") for i, t in docs], some + extra))
    assert found[0] == found[1] and (2, 700) in found[0] and 1 not in {x for x, _ in found[0]}
    assert {(1000 + i, i) for i, _ in some[:20]} <= found[0]


def test_pairs_that_lie_over_the_ends_of_bins():
    """Items that start anywhere, bins before them empty, one-word items beside doubled words."""
    items = [(1, "alpha beta gamma delta epsilon zeta eta theta iota"), (2, "echo"), (3, "bye bye"), (4, "one two three four five six seven eight nine ten eleven")]
    index = op8.Index(items)
    for k in range(60):
        texts = [("x " * k + t + " y" * 40).encode() for _, t in items]
        assert [set(x) for x in index.search(texts, 0.5)] == [{0}, {1}, {2}, {3}]
    assert index.search([b"bye and bye", b"", b"x"], 0.5) == [{}, {}, {}]
