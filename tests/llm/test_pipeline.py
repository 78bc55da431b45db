"""Near copies against brute force, and the stages one after another."""

import random

import corpus_pipeline
from tagwright.llm.common import words_az
from tagwright.llm.near_copies import fingerprint_links, leaders, loose_links, one_of_each, similar
from tagwright.llm.op7_simhash import shingles


def corpus(seed=1):
    rng = random.Random(seed)
    words = ["".join(rng.choice(["th", "er", "on", "an", "re", "mo", "li"]) for _ in range(rng.randrange(1, 5))) for _ in range(900)]
    rows, i = [], 0
    for g in range(40):
        base = [rng.choice(words) for _ in range(rng.randrange(60, 300))]
        for c in range(rng.randrange(1, 8)):
            w = list(base)
            for _ in range(0 if c == 1 else max(1, len(w) // 70) * (c > 0)):
                w[rng.randrange(len(w))] = rng.choice(words)
            rows.append((i, " ".join(w)))
            i += 1
    rows += [(i, None), (i + 1, ""), (i + 2, "One"), (i + 3, "one"), (i + 4, "two words"), (None, "two words"), (3, rows[3][1]), (3, "another text of it")]
    rng.shuffle(rows)
    return [(d, t, "en", "s", len(t or "")) for d, t in rows]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sets(text):
    return set(shingles(words_az((text or "").encode()), 5))


def survivors(rows):
    """The least (id, None last) of each component of similar texts, by comparing all pairs."""
    texts = {}
    for r in rows:
        texts.setdefault(b" ".join(words_az((r[1] or "").encode())), []).append(r)
    own = {w: sets(w.decode()) for w in texts}
    root = {w: w for w in texts}
    for a in texts:
        for b in texts:
            if root[a] != root[b] and similar(own[a], own[b]):
                root |= {w: root[a] for w in root if root[w] == root[b]}
    groups = {}
    for w, r in root.items():
        groups.setdefault(r, []).extend(texts[w])
    return {min((r[0] is None, r[0] or 0) for r in g) for g in groups.values()}


def test_one_of_each_group_stays(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA)
    want = sorted(survivors(rows))
    for chunk in (2_000_000, 1500):
        kept = one_of_each(df, chunk=chunk)
        assert kept.columns == df.columns
        got = [tuple(r) for r in kept.collect()]
        assert len(set(got)) == len(got) and set(got) <= set(rows)
        assert sorted((r[0] is None, r[0] or 0) for r in got) == want
    assert one_of_each(df.limit(0)).collect() == []


def test_columns_that_clash_stay(spark):
    rows = [(*r, 7, 8, 9, "a", "b") for r in corpus(5)]
    df = spark.createDataFrame(rows, SCHEMA + ", d_id long, d_hash long, `__id` long, `__own` string, stays string")
    kept = one_of_each(df)
    assert kept.columns == df.columns and sorted((r[0] is None, r[0] or 0) for r in kept.collect()) == sorted(survivors(rows))


def test_stages(spark, tmp_path):
    rng = random.Random(2)
    rows = [(d, t, a, s, n) for d, t, a, s, n in corpus(3) if d is not None and t and d > 3]
    labels = []
    for k in range(200):
        toxic = k % 4 == 0
        rows.append((5000 + k, " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randrange(50)) for _ in range(40)) + (" zukbad zukworse" if toxic else ""), "en", "s", 1))
        labels.append((5000 + k, 0, int(toxic)))
    item = "Which of these thoughts was written first of all? The third of the seven was."
    rows += [(9000, "some words before. " + item + " and after", "en", "s", 1), (9001, "write to a.b@c.org or not at all", "en", "s", 1)]
    sf = str(tmp_path)
    spark.createDataFrame(rows, SCHEMA).write.parquet(sf + "/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(sf + "/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(sf + "/benchmark.parquet")
    docs = spark.read.parquet(sf + "/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, sf)
        docs.write.parquet(f"{sf}/{name}")
        docs = spark.read.parquet(f"{sf}/{name}")
        seen.append({r["doc_id"] for r in docs.select("doc_id").collect()})
        assert name == "byte_bpe" or docs.columns == before.columns
    assert not any(5000 + k in seen[0] for k in range(0, 200, 4)) and {5001, 9000, 9001} <= seen[0]
    assert 9000 in seen[1] and 9000 not in seen[2] and seen[2] == seen[3] == seen[4]
    masked = {r["doc_id"]: (r["text"], r["n_chars"]) for r in spark.read.parquet(sf + "/pii").collect()}
    assert masked[9001] == ("write to [email] or not at all", 30)
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, sf).collect()} == seen[-1]


def test_leaders_of_all_chunks_meet(spark):
    rng = random.Random(4)
    own = {}
    for g in range(30):
        base = rng.sample(range(1000 * g, 1000 * g + 999), 24)
        for c in range(3):
            own[rng.getrandbits(40)] = set(base[:-1] if c == 1 else base + [1000 * g + 999] if c == 2 else base)
    rows = [(n, 0, k, rng.getrandbits(3), 0, sorted(s)) for k, (n, s) in enumerate(own.items())]
    members = spark.createDataFrame(rows, "node long, cluster long, place long, f0 long, f1 long, shingles array<long>").repartition(3)
    for chunk in (700, 3000, 5000):
        led = {r["node"]: r["leader"] for r in leaders(members, chunk).collect()}
        assert led.keys() == own.keys()
        kept = [n for n in led if led[n] == n]
        assert not [(a, b) for a in kept for b in kept if a < b and similar(own[a], own[b])], chunk
        assert len(kept) == 30


def test_all_texts_of_a_key_are_linked(spark):
    nodes = random.Random(5).sample(range(-(2**40), 2**40), 300)
    signed = spark.createDataFrame([(n, [7, 1000 + k, 5000 + k // 2]) for k, n in enumerate(nodes)] + [(1, [8]), (2, [])], "node long, keys array<long>")
    links = {(r["a"], r["b"]) for r in loose_links(signed).collect()}
    assert {(min(nodes), n) for n in nodes if n != min(nodes)} <= links and len(links) < 450
    assert {n for link in links for n in link} == set(nodes)


def test_copies_with_a_passage_appended_go(spark):
    rng = random.Random(6)
    texts = [[f"w{rng.randrange(10**6):06d}" for _ in range(200)] for _ in range(100)]
    texts += [t + [f"w{rng.randrange(10**6):06d}" for _ in range(47)] for t in texts]
    own = [sets(" ".join(t)) for t in texts]
    assert all(similar(own[k], own[100 + k]) for k in range(100))
    kept = one_of_each(spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string"))
    assert {r["doc_id"] for r in kept.collect()} == set(range(100))


def test_groups_are_joined_by_chains(spark):
    texts = []
    for k in range(20):
        middle = [f"w{k}x{i}" for i in range(100)]
        texts += [(k, middle[:20] + ["p", "q"] + middle[22:]), (20 + k, middle[:70] + ["r", "s"] + middle[72:]), (40 + k, middle)]
    own = {d: sets(" ".join(w)) for d, w in texts}
    assert all(similar(own[k], own[40 + k]) and similar(own[20 + k], own[40 + k]) and not similar(own[k], own[20 + k]) for k in range(20))
    docs = spark.createDataFrame([(d, " ".join(w)) for d, w in texts], "doc_id long, text string")
    for chunk in (600_000, 200):
        assert {r["doc_id"] for r in one_of_each(docs, chunk=chunk).collect()} == set(range(20))


def test_chunks_of_any_size_give_the_same_leaders(spark):
    rng = random.Random(8)
    own = {}
    for g in range(40):
        base = rng.sample(range(1000 * g, 1000 * g + 900), 30)
        for c in range(rng.choice([1, 2, 3, 12])):
            base = rng.sample(base, 29) + [1000 * g + 900 + c]
            own[rng.getrandbits(40)] = set(base)
    root = {n: n for n in own}
    for a in own:
        for b in own:
            if root[a] != root[b] and similar(own[a], own[b]):
                root |= {n: root[a] for n in root if root[n] == root[b]}
    place = {n: rng.getrandbits(30) for n in own}
    first = {r: min((n for n in own if root[n] == r), key=place.get) for r in root.values()}
    rows = [(n, 0, place[n], sorted(s)) for n, s in own.items()]
    members = spark.createDataFrame(rows, "node long, cluster long, place long, shingles array<long>").repartition(3)
    for chunk in (300, 2000, 600_000):
        assert {r["node"]: r["leader"] for r in leaders(members, chunk).collect()} == {n: first[root[n]] for n in own}


def test_short_copies_with_a_long_word_more_go(spark):
    rng = random.Random(7)
    texts = [[f"x{rng.randrange(1000):03d}" for _ in range(23)] + [f"longer{rng.randrange(10**5)}" for _ in range(7)] for _ in range(20)]
    texts += [t + [f"appended{k}"] for k, t in enumerate(texts)]
    assert all(similar(sets(" ".join(texts[k])), sets(" ".join(texts[20 + k]))) for k in range(20))
    kept = one_of_each(spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string"))
    assert {r["doc_id"] for r in kept.collect()} == set(range(20))


def test_near_copies_meet_by_golay_keys_of_fingerprints(spark):
    signed = spark.createDataFrame([(1, 0b0), (2, 0b0), (3, 0b1011), (4, 0b11110000), (5, 0b1 << 40)], "node long, fp long")
    assert {tuple(r) for r in fingerprint_links(signed).collect()} == {(1, 2), (1, 3), (1, 5)}
