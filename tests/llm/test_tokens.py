"""Token counts and byte-level BPE against the libraries themselves."""

import base64
import hashlib
import random

import public_tokenizers as P
import pytest

from tagwright.llm.op1_token_counts import Counter, count_overlapping, token_counts
from tagwright.llm.op4_byte_bpe import SegmentTreeBpe, byte_bpe

ALPHABET = ["a", "é", " ", "  ", "\n", "\t", "1", "23", "'s", "'", "<|endoftext|>", "<|endo", "the ", "xyz", "!", "\x1c", "　", "中", "𝔘", "mentation", ",", "\r\n", " "]


def texts(n, most, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(most))) for _ in range(n)]


@pytest.fixture(scope="module")
def counter():
    return Counter(P.path("byte_bpe_50k.json"))


def test_counts_equal_the_library(counter):
    some = texts(300, 60)
    assert counter.counts(some, 10_000, 64) == [len(counter.library.encode(t, add_special_tokens=False).ids) for t in some]


def test_overlaps_splice_to_the_same_count(counter):
    for t in texts(150, 600, seed=2) + ["a" * 5000, "ab " * 900, " " * 3000, "<|endoftext|>" * 300, "é" * 700 + " x" * 50]:
        want = len(counter.library.encode(t, add_special_tokens=False).ids)
        for chunk, overlap in ((200, 70), (300, 100), (1000, 128)):
            assert count_overlapping(counter.library, t, chunk, overlap) == want


def test_other_libraries():
    import sentencepiece

    s = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    some = ["", "the cat", "é  x\ny"]
    assert Counter(P.path("piece_bpe_32k.model")).counts(some, 100, 10) == [len(s.encode(t)) for t in some]


def test_counts_query_handles_odd_rows(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "", 5), (2, "", 5), (None, "a é", 5), (3, "the cat " * 9000, 5)], "doc_id long, text string, n_tokens int")
    got = sorted(map(tuple, token_counts(df, P.path("byte_bpe_50k.json")).collect()), key=str)
    assert len(got) == 5 and (1, 0, 0, False) in got and (2, 0, 0, False) in got and [r for r in got if r[0] == 3][0][1:] == (72000, 18001, True)
    assert token_counts(df.limit(0), P.path("byte_bpe_50k.json")).collect() == []


def reference():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_segment_tree_equals_tiktoken_and_round_trips():
    own, library = SegmentTreeBpe(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN, remembered=50), reference()
    rng = random.Random(4)
    some = texts(400, 80, seed=3) + ["a" * 3000, "".join(rng.choice("abcdeé") for _ in range(900)), "Donaudampfschifffahrtsgesellschaftskapitänsmützenabzeichen" * 4]
    for t in some:
        ids = own.encode(t)
        assert ids == library.encode_ordinary(t)
        assert own.decode(ids) == t.encode()


def test_bpe_query_handles_odd_rows(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (None, "né le", "x"), (4, "a b" * 3000, "x")], "doc_id long, text string, ids string")
    got = {r[0]: r for r in byte_bpe(df, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN, with_ids=True).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert got[1][1:4] == (0, empty, empty) == got[2][1:4]
    ids = reference().encode_ordinary("a b" * 3000)
    assert got[4]["n_tokens"] == len(ids) and got[4]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert got[4]["decoded_sha256"] == hashlib.sha256(("a b" * 3000).encode()).hexdigest() and got[4]["ids"] == ids
    assert byte_bpe(df.limit(0), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).collect() == []
