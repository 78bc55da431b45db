"""Recovered tags and fonts against plain readings."""

import itertools
import random

from pyspark.sql import functions as F

from tagwright.operators import match, recovery
from tagwright.sources import fonts


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_one_edit_by_deletions(spark):
    rng = random.Random(1)
    words = sorted({"".join(rng.choices("AB1", k=rng.randrange(5))) for _ in range(60)})
    df = spark.createDataFrame([(w,) for w in words], "a string")
    got = {(r["a"], r["b"]) for r in recovery.within_one_edit(df, df.withColumnRenamed("a", "b"), "a", "b").collect()}
    assert got == {(a, b) for a, b in itertools.product(words, words) if edits(a, b) <= 1}


def plain_correction(tag, refs):
    """Tries one substitution at each place, then two, in the fixed order of the pairs."""
    pairs = [(a, b) for a, b in (("O", "0"), ("I", "1"), ("S", "5"), ("B", "8"), ("Z", "2"), ("G", "6"), ("D", "0"), ("Q", "0"), ("U", "0"))]
    both = [p for a, b in pairs for p in ((a, b), (b, a))]
    t = tag.upper().strip()
    if t in refs:
        return t
    swap = lambda s: [(i, s[:i] + new + s[i + 1 :]) for i, c in enumerate(s) for old, new in both if c == old]
    for _, one in swap(t):
        if one in refs:
            return one
    for i, one in swap(t):
        for j, two in swap(one):
            if j != i and two in refs:
                return two
    return t


def test_corrections_against_plain_order(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("ODQU0I15SB8Z2G6X-", k=rng.randrange(3, 6)))
    refs = {word() for _ in range(2500)}
    tags = {word() for _ in range(1500)} | {" to1 ", "x"}
    found = recovery.corrected(spark.createDataFrame([(t,) for t in tags], "tag string"), spark.createDataFrame([(r, 1) for r in refs], "reference string, ref_seq int"))
    assert {r["tag"]: r["corrected"] for r in found.collect()} == {t: plain_correction(t, refs) for t in tags}


def test_corrections_of_nothing(spark):
    refs = spark.createDataFrame([], "reference string, ref_seq int")
    got = recovery.corrected(spark.createDataFrame([("a1",), ("",), (None,)], "tag string"), refs).collect()
    assert {(r["tag"], r["corrected"]) for r in got} == {("a1", "A1"), ("", ""), (None, None)}


def test_candidates_of_a_profile(spark):
    refs = match.references(spark.createDataFrame([("TIT-1001", 1), ("TIT-1002", 2), ("12AB-77", 3), ("7-LA-5", 4)], "reference string, ref_seq int"))
    texts = spark.createDataFrame([("TIT-1003, TlT-1004 and XYZABCD-1",), ("9-LA-6 LA-6 TIT_1003 (TIT-1001)",), ("12AB-9 word 123 A1",), (None,), ("",)], "text string")
    got = {}
    for r in recovery.candidates(texts, refs).collect():
        got.setdefault(r["text"], {})[r["tag"]] = round(r["score"], 2)
    assert set(got["TIT-1003, TlT-1004 and XYZABCD-1"]) == {"TIT-1003", "TLT-1004"}
    assert set(got["9-LA-6 LA-6 TIT_1003 (TIT-1001)"]) >= {"9-LA-6", "TIT-1003", "TIT-1001", "LA-6"}
    assert set(got["12AB-9 word 123 A1"]) == {"12AB-9"} and None not in got and "" not in got
    assert {r["prefix"]: r["after_area"] for r in recovery.prefixes(refs).collect()} == {"TIT": False, "12AB": False, "LA": True}
    none = recovery.candidates(texts, refs.limit(0)).collect()  # default prefixes
    assert "TIT-1003" in {r["tag"] for r in none}


def test_broken_fonts(spark):
    shift = lambda t: "".join(chr(ord(c) - 29) for c in t)
    rows = [
        ("a", 1, 1, "x", shift("TE-1001 TE-1002")), ("a", 1, 2, "x", shift("TE-1003-")), ("a", 1, 3, "y", "plain text, long enough"), ("a", 1, 4, "z", shift("TE-9")), ("a", 2, 5, "x", "other page"),
        ("a", 1, 6, None, shift("TE-2001 TE-2002 TE-3")), ("a", 1, 7, "y", "  "), ("a", 1, 8, "y", None), ("a", 1, 9, "w", "\x01\x02\x03\x04" + "Ж" * 20),
    ]
    spans = spark.createDataFrame([(*r, 0) for r in rows], "pdf string, page int, seq int, font string, text string, shifted int")
    got = {r["seq"]: r["text"] for r in fonts.repaired(spans).collect()}
    assert got[1] == "TE-1001 TE-1002" and got[2] == "TE-1003-" and got[3] == "plain text, long enough" and got[5] == "other page" and got[6] == "TE-2001 TE-2002 TE-3"
    assert got[4].startswith("7(") and 7 not in got and 8 not in got
    stats = {r["font"]: r for r in fonts.font_statistics(spans).filter(F.col("page") == 1).collect()}
    assert stats["x"]["shifted"] and stats[None]["shifted"] and not stats["y"]["shifted"] and stats["z"]["chars"] == 4 and not stats["z"]["shifted"]


def test_a_broken_page_fails_alone(spark):
    from pyspark.sql.types import IntegerType, StringType, StructField, StructType

    from tagwright.sources import guarded

    def read(content):
        if content == "crash":
            raise OSError("cannot open")
        return [(part, len(part)) if part != "odd" else (part, "no number") for part in content.split()]

    rows = [("a", 1, "TE-1 JB-2"), ("a", 2, "crash"), ("a", 3, ""), ("b", 1, "odd"), ("b", 2, None), ("b", 3, "PT-7"), (None, 4, "x")]
    pages = spark.createDataFrame([(*r, "status") for r in rows], "pdf string, page int, content string, status string").repartition(2)
    done = guarded.processed(pages, ["pdf", "page"], "content", read, StructType([StructField("text", StringType()), StructField("n", IntegerType())]))
    assert sorted(((r["pdf"], r["page"], r["text"], r["n"]) for r in guarded.rows_of(done).collect()), key=repr) == [("a", 1, "JB-2", 4), ("a", 1, "TE-1", 4), ("b", 3, "PT-7", 4), (None, 4, "x", 1)]
    stats = {r["pdf"]: (r["items"], r["failed"], r["found"], r["first_error"]) for r in guarded.run_statistics(done, ["pdf"]).collect()}
    assert stats["a"] == (3, 1, 2, "OSError: cannot open") and stats["b"][:3] == (3, 2, 1) and stats[None] == (1, 0, 1, None)
    assert guarded.processed(pages.limit(0), ["pdf"], "content", read, StructType([StructField("text", StringType()), StructField("n", IntegerType())])).collect() == []
