"""Tables handed out by a run, on a few pages written out by hand, and small relational operators of the store."""

import pytest
from pyspark.sql import functions as F

from tagwright.operators import drawing, match, reports, store

PAGES = {
    ("a", 1): ["JB-1", "MC-7", "TE-100", "TE-101", "SPARE", "NC-12-C"],
    ("a", 2): ["TE-100", "TE-555", "SPARE"],
    ("a", 3): ["JB-2", "JB-3", "TE-900"],
    ("b", 1): ["JB-1", "te_102", "QQ-1"],
    ("b", 2): ["JB-1"],
}
SPANS = [(pdf, page, k, 10, 20 * k, 30, 10, 0.9, t) for (pdf, page), texts in PAGES.items() for k, t in enumerate(texts)]
SPAN_TYPE = "pdf string, page long, seq long, x int, y int, w int, h int, confidence double, text string"
REFS = [("TE-100", 1), ("TE 101", 2), ("TE-102", 3), ("PT-7", 4)]


@pytest.fixture(scope="module")
def made(spark):
    spans = drawing.classified(spark.createDataFrame(SPANS, SPAN_TYPE)).cache()
    refs = match.references(spark.createDataFrame(REFS, "reference string, ref_seq int"))
    recovered = spark.createDataFrame([("QQ-1", 0.7), ("QQ-1", 0.65)], "tag string, score double")
    verdicts = reports.judged(spans.filter("kind = 'Tag'").select(F.col("token").alias("tag")), refs, recovered).cache()
    motors = spans.filter("kind = 'MC'").select("pdf", "page", F.col("token").alias("motor"))
    inter = reports.intermediate_table(spans, verdicts, motors, terminals="T{2*x-1}, SCR {x}, T{2*x}").cache()
    return spans, refs, verdicts, inter


def test_reasons(made):
    of = {r["tag"]: r for r in made[2].collect()}
    assert of["TE-100"]["reason"] == "Exact IO List match: TE-100" and of["TE-101"]["match_type"] == "exact"
    score = of["TE-555"]["score"]
    kind = {True: "Not in IO List", False: "Matches learned IO List pattern but is absent"}[of["TE-555"]["match_type"] == "similar"]
    assert of["TE-555"]["reason"] == f"{kind}; closest tag: {of['TE-555']['closest']} ({score:.1%}). Review required." and of["TE-555"]["in_family"]
    assert of["QQ-1"]["reason"] == "IO-independent OCR profile candidate (shape score 0.70); not matched to an IO tag; review required."
    assert (of["QQ-1"]["match_type"], of["QQ-1"]["score"], of["QQ-1"]["closest"], of["QQ-1"]["in_family"]) == ("unmatched_candidate", 0.0, "", False)


def test_intermediate(made):
    rows = [r.asDict() for r in made[3].collect()]
    assert [(r["PDF_Name"], r["Page"], r["Tag/SPARE"], r["Tag_Number"]) for r in rows] == [
        ("a", 1, "TE-100", 1), ("a", 1, "TE-101", 2), ("a", 1, "SPARE", 3), ("a", 2, "TE-100", 1), ("a", 2, "TE-555", 2), ("a", 2, "SPARE", 3), ("b", 1, "TE_102", 1), ("b", 1, "QQ-1", 2)]
    first, spare, lost = rows[0], rows[2], rows[5]
    assert (first["JB"], first["MC"], first["Wire_Code_1"], first["Wire_Code_2"], first["Cable_Code"]) == ("JB-1", "MC-7", "BK01", "WT01", "NC-12-C")
    assert (first["Terminal_First_Number"], first["Terminal_Second_Number"], first["SCR_Terminal_Number"]) == ("T1", "T2", "SCR 1")
    assert (first["Tag_Number_Status"], first["Warning"], first["Match_Type"], first["Similarity_Percent"]) == ("Exact Match (score: 1.000)", "", "exact", 100.0)
    assert (spare["Type"], spare["Match_Type"], spare["IO_Pattern_Match"], spare["Warning"]) == ("SPARE", None, None, "")
    assert lost["JB"] == "JB_NOT_FOUND (page 2)" and lost["MC"] == ""
    assert lost["Warning"] == "JB_NOT_FOUND: page 2 has SPARE SPARE but no JB was detected on this page. SPARE was NOT assigned to any JB."
    assert rows[3]["Warning"] == " JB_NOT_FOUND: page 2 has tag TE-100 but no JB was detected on this page. Tag was NOT assigned to any JB."
    assert len(rows[0]) == 20
    seen = {(r["Tag/SPARE"], r["source_type"], r["score"] is None) for r in reports.candidates_for_review(made[3]).collect()}
    assert seen == {("TE-555", "pattern_unmatched_candidate", False), ("QQ-1", "io_profile_recovery", True)}


def test_final(spark, made):
    io = spark.createDataFrame([(1, "TE-100", "old"), (2, "te 101", "old"), (3, "TE-102", None), (4, "PT-7", "own"), (5, None, "own")], "seq int, tag string, jb string")
    rows = [r.asDict() for r in reports.final_table(io, made[3], made[1]).collect()]
    listed = {r["seq"]: r for r in rows if r["seq"] is not None}
    assert {k: (r["jb"], r["PDF_Name"], r["Page"], r["JB_SPARE_COUNT"]) for k, r in listed.items()} == {1: ("JB-1", "a", 1, 1), 2: ("JB-1", "a", 1, 1), 3: ("JB-1", "b", 1, 1), 4: ("own", None, None, 0), 5: ("own", None, None, 0)}
    extra = sorted((r["tag"], r["jb"], r["JB_SPARE_COUNT"], r["Match_Type"]) for r in rows if r["seq"] is None and r["tag"] != "TE-555" and r["tag"] != "SPARE")
    assert extra == [("QQ-1", "JB-1", 1, "unmatched_candidate")] and sorted(r["tag"] for r in rows if r["seq"] is None) == ["QQ-1", "SPARE", "SPARE", "TE-555"]
    of = {r["tag"]: r["Warning"] for r in rows if r["seq"] is None}
    assert of["QQ-1"].startswith("Recovered by OCR profile; no IO-family match. Review required. IO-independent OCR profile candidate (shape")
    assert of["TE-555"].startswith("Not in IO List; closest tag: TE") and of["TE-555"].count("Review required.") == 2
    assert reports.final_table(io.limit(0), made[3].limit(0), made[1]).count() == 0


def test_warnings(spark, made):
    rows = reports.warnings_report(made[0]).collect()
    assert [(r["Severity"], r["Warning_Type"], r["Item"], r["PDF_Name"], r["Pages"], r["Tag_Count"]) for r in rows] == [
        ("ERROR", "PAGE_SKIPPED_MULTIPLE_JB", "JB-2,JB-3", "a", "3", 1),
        ("WARNING", "DUPLICATE_JB", "JB-1", "b", "1, 2", 0),
        ("WARNING", "DUPLICATE_TAG", "TE-100", "a", "1, 2", 0),
        ("WARNING", "JB_NOT_FOUND", "JB_NOT_FOUND (page 2)", "a", "2", 3),
    ]
    assert rows[0]["Description"].endswith("detected: ['JB-2', 'JB-3']. 1 tags on this page were NOT exported.") and rows[2]["Description"] == "Tag 'TE-100' appears on 2 pages of 'a': [1, 2]."
    assert "contains 2 tag(s) and 1 spare(s)" in rows[3]["Description"]
    none = reports.warnings_report(made[0].limit(0)).collect()
    assert [(r["Warning_Type"], r["Severity"], r["Tag_Count"]) for r in none] == [("NONE", "SUCCESS", 0)]


def test_empty_tables(made):
    spans, _, verdicts, _ = made
    assert reports.intermediate_table(spans.limit(0), verdicts).count() == 0
    bare = reports.intermediate_table(spans, verdicts.limit(0)).filter(F.col("Type") == "Tag").select("Tag_Number_Status", "Match_Type", "MC", "SCR_Terminal_Number").distinct().collect()
    assert [tuple(r) for r in bare] == [("Assigned", "unmatched", "", "")]


def test_owners(spark):
    projects = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    runs = spark.createDataFrame([(10, 1, "u"), (11, 1, "v"), (12, 2, "v"), (13, 2, None)], "id int, project_id int, initiated_by string")
    ids = lambda df: sorted(r[0] for r in df.collect())
    assert ids(store.owned_projects(projects, runs, "u")) == [1] and ids(store.owned_projects(projects, runs, "u", unstarted=True)) == [1, 3]
    assert ids(store.owned_projects(projects, runs, "Admin")) == [1, 2, 3] and ids(store.owned_runs(runs, "v")) == [11, 12]
    artifacts = spark.createDataFrame([(10, "x"), (12, "y"), (99, "z")], "run_id int, path string")
    assert ids(store.permitted(artifacts, runs, "v")) == [12] and ids(store.permitted(artifacts, runs, "admin")) == [10, 12, 99]


def test_intermediate_rows_are_dealt_once_by_page(made):
    spans, _, verdicts, _ = made
    motors = spans.filter("kind = 'MC'").select("pdf", "page", F.col("token").alias("motor"))
    plan = reports.intermediate_table(spans, verdicts, motors)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange rangepartitioning(pdf") == 1 and "hashpartitioning(pdf" not in plan


def test_final_table_reads_its_rows_once_and_makes_texts_last(spark, made):
    spans, refs, verdicts, inter = made
    io = spark.createDataFrame([(1, "TE-100", "old"), (2, "te 101", "old"), (3, "PT-7", "own")], "seq int, tag string, jb string")
    motors = spans.filter("kind = 'MC'").select("pdf", "page", F.col("token").alias("motor"))
    plan = reports.final_table(io, reports.intermediate_table(spans, verdicts, motors), refs)._jdf.queryExecution().executedPlan().toString()
    assert "partitioning(pdf" not in plan
    late = reports.final_table(io, reports.intermediate_rows(spans, verdicts, motors), refs, columns=reports.intermediate_columns(terminals="T{2*x-1}, SCR {x}, T{2*x}"))
    want = reports.final_table(io, inter, refs)
    assert late.columns == want.columns and sorted(map(repr, late.collect())) == sorted(map(repr, want.collect()))
