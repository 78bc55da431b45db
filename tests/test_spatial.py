"""Names by a project's examples, and operators on places, against plain readings."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from tagwright.operators import catalogue as C
from tagwright.operators import drawing, match, spatial
from tagwright.plans import sheets

SPANS = "pdf string, page long, seq long, x int, y int, w int, h int, text string, confidence double"


def kinds(spark, texts, given):
    rows = [("a", 1, k, 0, 0, 1, 1, t, 1.0) for k, t in enumerate(texts)]
    found = C.classified(spark.createDataFrame(rows, SPANS), given).orderBy("seq").collect()
    return [(r["kind"], r["token"]) for r in found]


def test_names_of_a_project(spark):
    given = C.Catalogue(boxes="12JB", motors=["NC"], spares="SPARE", cables="12P, 3T")
    texts = {
        "JB-101": ("JB", "12JB-101"), "12 JB 7": ("JB", "12JB7"), "jb.101ab-x1": ("JB", "12JB.101AB-X1"), "see JB 5 here": ("JB", "12JB5"), "XJB-5": ("Unknown", "XJB-5"), "JB To ITR 100": ("Unknown", "JB TO ITR 100"),
        "NC-JB-22S": ("MC", "NC-JB-22S"), "JB-5 NC-7": ("JB", "12JB-5"), "2 SPARES": ("SPARE", "SPARE"), "SPAREX-10": ("Unknown", "SPAREX-10"), "FIT-100-14": ("Tag", "FIT-100-14"), "FIT_100.14 2": ("Tag", "FIT-100-14 2"),
        "FV-2233  17": ("Tag", "FV-2233  17"), "08 PR x 2.5": ("Cable", "8 pair"), "ABC-3 TRIPLE": ("Cable", "3 triple"), "3 CORE": ("Unknown", "3 CORE"), "02-JULY-2025": ("Unknown", "02-JULY-2025"), "IP-66": ("Unknown", "IP-66"),
        "12BK": ("Unknown", "12BK"), "SCR-1": ("Unknown", "SCR-1"), "": ("Unknown", ""), None: ("Unknown", ""),
    }
    assert dict(zip(texts, kinds(spark, texts, given), strict=True)) == texts


def test_empty_lists_and_unset_ones(spark):
    texts = ["JB-101", "MC-7", "SPARE", "NC-1-2", "TE-100"]
    assert [k for k, _ in kinds(spark, texts, C.Catalogue())] == ["JB", "MC", "SPARE", "Cable", "Tag"]
    assert [k for k, _ in kinds(spark, texts, C.Catalogue([], "", [], " "))] == ["Tag", "Unknown", "Unknown", "Unknown", "Tag"]
    assert C.Catalogue(boxes=["--"]).box == C.NEVER


def test_rules_of_wires_and_several_examples(spark):
    given = C.Catalogue(boxes=["JSF", "JSX JSY"], wire_rule="WRE{x:02d}, A{x}", scr_rule="SHD")
    assert kinds(spark, ["WRE-101", "SHD-200", "JSY-1", "1201 JSF-2"], given) == [("Unknown", "WRE-101"), ("Unknown", "SHD-200"), ("JB", "JSY-1"), ("JB", "1201JSF-2")]
    assert C.cable_units("12P; 4 core; 7T, x") == ["pair", "triple", "core"] and C.cable_units("blue") == []


@pytest.fixture(scope="module")
def sheet(spark):
    return sheets._by_area(spark, "/root/testdata/sf0.001").cache()


def test_cables_use_all_windows(sheet):
    rows = [r.asDict() for r in sheet.collect()]
    want = {}
    for m in (r for r in rows if r["kind"] == "MC"):
        for k, (left, right, up) in enumerate(spatial.WINDOWS, 1):
            near = [
                (abs(c["x"] - m["x"]) + 3 * abs(c["y"] - m["y"]) + 40 * (c["y"] < m["y"]), len(c["text"]), c["y"], c["x"], c["seq"])
                for c in rows
                if c["kind"] == "Cable" and (c["pdf"], c["page"]) == (m["pdf"], m["page"]) and -left <= c["x"] - m["x"] <= right and abs(c["y"] - m["y"]) <= up
            ]
            if near:
                want[m["page"], m["seq"]] = (min(near)[4], k)
                break
    got = {(r["page"], r["seq"]): (r["cable_seq"], r["window"]) for r in spatial.nearest_cables(sheet).collect()}
    assert got == want and {k for _, k in want.values()} == {1, 2, 3}


def test_best_motors_against_plain_reading(sheet):
    pages = sheet.withColumn("page", F.floor(F.col("page") / 40))

    def ratio(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
            row = new
        return 2 * row[-1] / (len(a) + len(b))

    want, by_page = {}, {}
    for r in pages.collect():
        by_page.setdefault((r["pdf"], r["page"]), []).append(r)
    for page, rows in by_page.items():
        motors = {r["token"] for r in rows if r["kind"] == "MC"}
        fits = [m for m in motors if re.match(r"(MC|NC)[^A-Z]", m) and re.search("[0-9]", m)]
        boxes = sorted(r["token"] for r in rows if r["kind"] == "JB")
        expected = next(("MC" + boxes[0][len(p) :] for p in ("12JB", "1201JM") if boxes and boxes[0].startswith(p) and boxes[0] != p), None)
        if fits:
            want[page] = max(fits, key=lambda m: (ratio(m, expected) if expected else 0.0, sum(c.isdigit() for c in m), sum(c in "-_." for c in m), -len(m), m))
    got = {(r["pdf"], r["page"]): r["motor"] for r in spatial.best_motors(pages, sheets.BY_AREA).collect()}
    assert got == want and len(want) > 10
    assert spatial.best_motors(pages, C.Catalogue(motors=[])).collect() == []


def test_words_are_dealt_like_a_plain_search():
    word = lambda k, t: (0, 10 * k, 8, 5, 1.0, t)
    one = spatial.dealt_words(["TE-100", "FT-7"], [word(k, t) for k, t in enumerate(["TE", "-", "100", "x", "FT7"])])
    assert [(w[5], w[1], w[2]) for w in one] == [("TE-100", 0, 28), ("x", 30, 8), ("FT-7", 40, 8)]
    assert spatial.dealt_words(["TE-100"], [word(k, c) for k, c in enumerate("TE-1x00")]) is None
    assert spatial.dealt_words(["ABCDEFGH1"], [word(k, c) for k, c in enumerate("ABCDEFGH1")]) is None  # nine words
    assert spatial.dealt_words(["A1"], []) is None
    rng = random.Random(3)
    for _ in range(300):
        words = [word(k, "".join(rng.choices("AB1-", k=rng.randrange(1, 3)))) for k in range(rng.randrange(1, 7))]
        candidates = ["".join(rng.choices("AB1", k=2)) for _ in range(2)]
        used, ok = set(), True
        for c in dict.fromkeys(candidates):
            for i, j in itertools.combinations(range(len(words) + 1), 2):
                if not used & set(range(i, j)) and "".join(w[5] for w in words[i:j]).replace("-", "") == c:
                    used |= set(range(i, j))
                    break
            else:
                ok = False
        assert (spatial.dealt_words(candidates, words) is not None) == ok


def test_words_across_cells_and_a_span_that_stays(spark):
    spans = spark.createDataFrame([("a", 1, 1, 200, 250, 600, 20, "TE-1 TE-2", 0.9), ("a", 1, 2, 0, 0, 10, 10, "TE-3 TE-4", 0.9)], SPANS)
    words = spark.createDataFrame([("a", 1, 1, 198, 248, 50, 24, "TE-1", 0.5), ("a", 1, 2, 700, 255, 102, 10, "TE-2", 0.7), ("a", 1, 3, 0, 0, 5, 5, "TE-3", 0.7), ("a", 2, 4, 200, 250, 5, 5, "TE-1", 0.7)], SPANS)
    assert {(r["seq"], r["word_seq"]) for r in spatial.words_inside(spans, words).collect()} == {(1, 1), (1, 2), (2, 3)}
    given = spans.withColumns({"candidates": F.split("text", " "), "alone": F.lit(False)})
    got = [(r["seq"], r["part"], r["text"], r["confidence"]) for r in spatial.split_spans(given, words).orderBy("seq", "part").collect()]
    assert got == [(1, 0, "TE-1", 0.5), (1, 1, "TE-2", 0.7), (2, 0, "TE-3 TE-4", 0.9)]


def test_fragments_are_taken_once(spark):
    rows = [("TE", 0, 20), ("-", 22, 5), ("10", 30, 10), ("0", 42, 5), ("TE-7", 60, 30), ("TE", 100, 20), ("5", 200, 5)]
    spans = spark.createDataFrame([("a", 1, k, x, 0, w, 10, t, 1.0) for k, (t, x, w) in enumerate(rows)], SPANS).withColumn("known", F.col("text").rlike(drawing.TAG) | (F.col("text") == "TE-7"))
    refs = match.references(spark.createDataFrame([("TE-100", 1)], "reference string, ref_seq int"))
    got = [(r["seq"], r["last_seq"], r["text"], r["x"], r["w"]) for r in spatial.joined_fragments(spans, refs).orderBy("seq").collect()]
    assert got == [(0, 2, "TE - 10", 0, 40), (3, 3, "0", 42, 5), (4, 4, "TE-7", 60, 30), (5, 5, "TE", 100, 20), (6, 6, "5", 200, 5)]


def test_splits_come_in_one_stream(spark):
    """Groups that go over batches, spans without words and repeated spans, against a plain search for each span; no sort of words for each span in Python."""
    rng = random.Random(8)
    spans = [("a", p, k, 0, 100 * k, 600, 20, f"TE-{rng.randrange(2)} FT-{rng.randrange(2)}", 0.9) for p in range(6) for k in range(5)]
    words = [("a", p, 10 * k + j, rng.randrange(0, 400), 100 * k + rng.randrange(3), 20, 9, t, rng.random())
             for p in range(5) for k in range(5) for j, t in enumerate(rng.choices(["TE-0", "TE-1", "TE", "0", "1", "FT-0", "FT-1", "FT", "x"], k=rng.randrange(12)))]
    spans.append(spans[0])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        given = spark.createDataFrame(spans, SPANS).withColumns({"candidates": F.split("text", " "), "alone": F.col("seq") == 4})
        out = spatial.split_spans(given, spark.createDataFrame(words, SPANS))
        got = sorted(map(tuple, out.collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = []
    for s in spans:
        own = sorted((w[4], w[3], w[2], *w[5:7], w[8], w[7]) for w in words if w[1] == s[1] and s[4] - 2 <= w[4] <= s[4] + 11)
        own = [w for w in own for _ in range(1 + (s is spans[0] or s is spans[-1]))]
        made = None if s[2] == 4 else spatial.dealt_words(s[7].split(), [(w[0], w[1], *w[3:]) for w in own])
        want += [(*s[:3], k, x, y, w, h, t, c) for k, (y, x, w, h, c, t) in enumerate(made)] if made else [(*s[:3], 0, *s[3:])]
    assert got == sorted(want)
    assert len(got) > len(spans)
    assert "Pandas" not in out._jdf.queryExecution().toString() and "ArrowEvalPython" not in out._jdf.queryExecution().toString()


def test_views_of_lines_number_them_once(spark):
    for name in ("t11_split_spans", "j09_joined_fragments", "j13_s15_words_inside"):
        assert "l_linenumber" not in sheets.query.__globals__["QUERIES"][name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()


def test_runs_count_by_their_shapes(spark, monkeypatch):
    """Pages over several batches; what is held against the families doesn't grow with the numbers."""
    rows = [("a", p, 10 * k + j, x, 40 * k, w, 10, t, 1.0) for p in range(4) for k in range(30) for j, (t, x, w) in enumerate([("TE", 0, 20), ("-", 22, 5), (str(100 + 37 * k + p), 30, 10), ("9", 90, 5)])]
    spans = spark.createDataFrame(rows, SPANS).withColumn("known", F.lit(False))
    seen = []
    members = match.members
    monkeypatch.setattr(match, "members", lambda tags, refs, column: seen.append(tags.distinct().count()) or members(tags, refs, column))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = sorted((r["page"], r["seq"], r["last_seq"], r["text"], r["x"], r["w"]) for r in spatial.joined_fragments(spans, match.references(spark.createDataFrame([("TE-100", 1)], "reference string, ref_seq int"))).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = [(p, 10 * k, 10 * k + 2, f"TE - {100 + 37 * k + p}", 0, 40) for p in range(4) for k in range(30)] + [(p, 10 * k + 3, 10 * k + 3, "9", 90, 5) for p in range(4) for k in range(30)]
    assert got == sorted(want) and seen == [5]  # TE -, TE - 000, TE - 0000, - 000, - 0000
