"""Queries over the tables that a run hands out, and over its stored runs, issues and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import match, reports, store
from . import adapters as A
from .queries import SQL_CABLE, SQL_KIND, SQL_NUMBERED, _classified, _rows, query

# Verdicts of every type for the drawings' tags, some of them recovered by the profile.
VERDICTS = """
SELECT DISTINCT concat('TE', CASE WHEN l_partkey % 3 = 0 THEN '_' ELSE '-' END, CAST(l_partkey AS STRING)) AS tag,
  CASE l_partkey % 5 WHEN 0 THEN 'exact' WHEN 1 THEN 'similar' WHEN 2 THEN 'unmatched_candidate' ELSE 'unmatched' END AS match_type,
  CASE l_partkey % 5 WHEN 0 THEN 1.0 WHEN 1 THEN (75 + l_partkey % 24) / CAST(100.0 AS DOUBLE) WHEN 2 THEN l_partkey % 75 / CAST(100.0 AS DOUBLE) ELSE 0.0 END AS score,
  CASE WHEN l_partkey % 5 < 3 THEN concat('TE-', CAST(l_partkey + l_partkey % 5 AS STRING)) ELSE '' END AS closest,
  CASE WHEN l_partkey % 7 = 0 THEN (62 + l_partkey % 30) / CAST(100.0 AS DOUBLE) END AS profile_score, l_partkey % 5 < 3 AS in_family FROM lineitem
"""
SQL_REASONS = f"""
v0 AS ({VERDICTS}), v1 AS (SELECT *, profile_score IS NOT NULL AND match_type <> 'similar' AS alone, CASE WHEN closest = '' THEN 'none' ELSE closest END || ' (' || format('{{:.1f}}%', 100 * score) || ')' AS known FROM v0),
v AS (SELECT tag, CASE WHEN alone THEN 'unmatched_candidate' ELSE match_type END AS match_type, CAST(CASE WHEN alone THEN 0 ELSE score END AS DOUBLE) AS score, CASE WHEN alone THEN '' ELSE closest END AS closest, in_family,
  CASE WHEN alone THEN 'IO-independent OCR profile candidate (shape score ' || format('{{:.2f}}', profile_score) || '); not matched to an IO tag; review required.'
  WHEN profile_score IS NOT NULL THEN 'IO-independent OCR profile candidate; legacy structural similarity: ' || known || '; review required.' WHEN match_type = 'exact' THEN 'Exact IO List match: ' || closest
  WHEN match_type = 'similar' THEN 'Not in IO List; closest tag: ' || known || '. Review required.' ELSE 'Matches learned IO List pattern but is absent; closest tag: ' || known || '. Review required.' END AS reason FROM v1)"""
SQL_INTERMEDIATE = f"""{SQL_KIND}, {SQL_NUMBERED}, {SQL_CABLE}, {SQL_REASONS},
pg AS (SELECT pdf, page, count(DISTINCT token) FILTER (kind = 'JB') AS boxes, max(token) FILTER (kind = 'JB') AS box, min(token) FILTER (kind = 'MC') AS motor FROM s GROUP BY pdf, page),
it AS (SELECT n.*, pg.boxes, pg.box, pg.motor, cable, n.kind = 'SPARE' AS spare, CASE WHEN n.kind = 'SPARE' THEN 'SPARE' ELSE n.token END AS item, v.match_type, score, closest, reason, in_family
  FROM numbered n JOIN pg ON n.pdf = pg.pdf AND n.page = pg.page AND boxes < 2 LEFT JOIN cable ON n.pdf = cable.pdf AND n.page = cable.page LEFT JOIN v ON n.token = v.tag),
inter AS (SELECT pdf AS "PDF_Name", page AS "Page", CASE WHEN boxes = 0 THEN 'JB_NOT_FOUND (page ' || page || ')' ELSE box END AS "JB", coalesce(motor, '') AS "MC", item AS "Tag/SPARE", number AS "Tag_Number",
  'BK' || lpad(CAST(number AS VARCHAR), 2, '0') AS "Wire_Code_1", 'WT' || lpad(CAST(number AS VARCHAR), 2, '0') AS "Wire_Code_2", 'T' || CAST(2 * number - 1 AS VARCHAR) AS "Terminal_First_Number", 'T' || CAST(2 * number AS VARCHAR) AS "Terminal_Second_Number",
  coalesce(cable, '') AS "Cable_Code", 'SCR' || CAST(number AS VARCHAR) AS "SCR_Terminal_Number", coalesce(cable, '') AS "Cable_Description", kind AS "Type",
  CASE WHEN spare THEN 'Assigned (Position-based)' WHEN match_type IS NULL THEN 'Assigned' WHEN match_type = 'exact' THEN 'Exact Match (score: 1.000)' WHEN match_type = 'similar' THEN format('Similar Match (score: {{:.3f}})', score) ELSE 'Not in IO List (pattern candidate)' END AS "Tag_Number_Status",
  CASE WHEN spare OR match_type IS NULL OR match_type = 'exact' THEN '' ELSE reason END || CASE WHEN boxes > 0 THEN '' WHEN spare THEN 'JB_NOT_FOUND: page ' || page || ' has SPARE ' || item || ' but no JB was detected on this page. SPARE was NOT assigned to any JB.'
  ELSE ' JB_NOT_FOUND: page ' || page || ' has tag ' || item || ' but no JB was detected on this page. Tag was NOT assigned to any JB.' END AS "Warning",
  CASE WHEN NOT spare THEN coalesce(match_type, 'unmatched') END AS "Match_Type", CASE WHEN NOT spare THEN coalesce(round(100 * score, 2), 0) END AS "Similarity_Percent", CASE WHEN NOT spare THEN coalesce(closest, '') END AS "Closest_IO_Tag", CASE WHEN NOT spare THEN coalesce(in_family, false) END AS "IO_Pattern_Match" FROM it)"""
TERMINALS = "T{2*x-1}, T{2*x}, SCR{x}"
IO_LIST = "SELECT p_partkey AS seq, concat('TE-', CAST(p_partkey + 300 AS STRING)) AS tag, concat('JB-', CAST(p_size AS STRING)) AS jb FROM part"


def _inter_rows(spark: SparkSession, sf: str) -> DataFrame:
    spans = _classified(spark, sf)
    motors = spans.filter("kind = 'MC'").groupBy("pdf", "page").agg(F.min("token").alias("motor"))
    return reports.intermediate_rows(spans, reports.with_reasons(A.view(spark, sf, VERDICTS)), motors)


def _inter(spark: SparkSession, sf: str) -> DataFrame:
    return _inter_rows(spark, sf).select(*(c.alias(name) for name, c in reports.intermediate_columns(terminals=TERMINALS).items()))


@query(f"WITH {SQL_REASONS} SELECT tag, match_type, score, closest, reason FROM v")
def t14_reasons(spark, sf):
    return reports.with_reasons(A.view(spark, sf, VERDICTS)).select("tag", "match_type", "score", "closest", "reason")


@query(f"WITH {SQL_INTERMEDIATE} SELECT * FROM inter")
def k01_intermediate_table(spark, sf):
    return _inter(spark, sf)


@query(f"""WITH {SQL_INTERMEDIATE} SELECT "PDF_Name", "Page", "Tag/SPARE", "Tag_Number", "Match_Type", CASE WHEN contains("Warning", 'IO-independent OCR') THEN 'io_profile_recovery' ELSE 'pattern_unmatched_candidate' END AS source_type,
  CASE WHEN NOT contains("Warning", 'IO-independent OCR') THEN "Similarity_Percent" / 100 END AS score FROM inter WHERE "Match_Type" <> 'exact' AND ("IO_Pattern_Match" OR contains("Warning", 'IO-independent OCR'))""")
def f27_review_candidates(spark, sf):
    return reports.candidates_for_review(_inter(spark, sf)).select("PDF_Name", "Page", "Tag/SPARE", "Tag_Number", "Match_Type", "source_type", "score")


_ADDED = ['"PDF_Name"', '"Page"', '"MC"', '"Tag_Number"', '"Wire_Code_1"', '"Wire_Code_2"', '"Terminal_First_Number"', '"Terminal_Second_Number"', '"Cable_Code"', '"SCR_Terminal_Number"', '"Cable_Description"', '"Type"', '"Tag_Number_Status"']
_JUDGED = ['"Warning"', '"Match_Type"', '"Similarity_Percent"', '"Closest_IO_Tag"', '"IO_Pattern_Match"']


@query(f"""WITH {SQL_INTERMEDIATE}, io AS ({IO_LIST}), x AS (SELECT inter.*, io.tag AS ref, "Type" = 'SPARE' AS sp FROM inter LEFT JOIN io ON replace("Tag/SPARE", '_', '-') = io.tag),
ff AS (SELECT *, row_number() OVER (PARTITION BY ref ORDER BY "PDF_Name", "Page", "Tag_Number", sp, "Tag/SPARE") AS k FROM x WHERE ref IS NOT NULL),
listed AS (SELECT io.seq, io.tag, CASE WHEN ff.ref IS NOT NULL THEN ff."JB" ELSE io.jb END AS jb, {', '.join(_ADDED + _JUDGED)} FROM io LEFT JOIN ff ON io.tag = ff.ref AND k = 1),
e AS (SELECT *, NOT sp AND NOT "IO_Pattern_Match" AND "Match_Type" <> 'similar' AS bare, CASE WHEN "Closest_IO_Tag" = '' THEN 'none' ELSE "Closest_IO_Tag" END || ' (' || format('{{:.1f}}%', "Similarity_Percent") || ')' AS known
  FROM x WHERE sp OR (ref IS NULL AND ("IO_Pattern_Match" OR contains("Warning", 'IO-independent OCR')))),
absent AS (SELECT NULL AS seq, "Tag/SPARE" AS tag, "JB" AS jb, {', '.join(_ADDED)}, CASE WHEN sp THEN "Warning" WHEN "IO_Pattern_Match" THEN 'Not in IO List; closest tag: ' || known || '. Review required. ' || "Warning" ELSE 'Recovered by OCR profile; no IO-family match. Review required. ' || "Warning" END AS "Warning",
  CASE WHEN bare THEN 'unmatched_candidate' ELSE "Match_Type" END AS "Match_Type", CASE WHEN bare THEN 0 ELSE "Similarity_Percent" END AS "Similarity_Percent", CASE WHEN bare THEN '' ELSE "Closest_IO_Tag" END AS "Closest_IO_Tag", "IO_Pattern_Match" FROM e),
every AS (SELECT * FROM listed UNION ALL SELECT * FROM absent), counts AS (SELECT "JB" AS box, count(*) AS n FROM inter WHERE "Type" = 'SPARE' GROUP BY 1)
SELECT every.*, coalesce(n, 0) AS "JB_SPARE_COUNT" FROM every LEFT JOIN counts ON jb = box""")
def k02_u04_final_table(spark, sf):
    io = A.view(spark, sf, IO_LIST)
    return reports.final_table(io, _inter_rows(spark, sf), match.references(io, "tag", "seq"), columns=reports.intermediate_columns(terminals=TERMINALS))


SQL_WARNINGS = f"""{SQL_KIND},
pw AS (SELECT pdf, page, list_sort(list(DISTINCT token) FILTER (kind = 'JB')) AS b, count(DISTINCT token) FILTER (kind = 'Tag') AS tags, count(*) FILTER (kind = 'SPARE') AS spares FROM s GROUP BY pdf, page),
w1 AS (SELECT 'PAGE_SKIPPED_MULTIPLE_JB' AS "Warning_Type", array_to_string(b, ',') AS "Item", pdf AS "PDF_Name", CAST(page AS VARCHAR) AS "Pages", tags AS "Tag_Count", 'ERROR' AS "Severity",
  'Page ' || page || ' of ''' || pdf || ''' was SKIPPED because multiple JB identifiers were detected: [''' || array_to_string(b, ''', ''') || ''']. ' || tags || ' tags on this page were NOT exported.' AS "Description",
  'Manually review the page and choose the correct JB, or split the page so it contains a single JB.' AS "Action", page, 0 AS class FROM pw WHERE len(b) > 1),
w2 AS (SELECT 'JB_NOT_FOUND', 'JB_NOT_FOUND (page ' || page || ')', pdf, CAST(page AS VARCHAR), tags + spares, 'WARNING', 'Page ' || page || ' of ''' || pdf || ''' contains ' || tags || ' tag(s) and ' || spares || ' spare(s), but NO JB identifier could be detected.',
  'Check the page header (top of page).', page, 0 FROM pw WHERE b IS NULL AND tags + spares > 0),
d AS (SELECT kind, token, pdf, list_sort(list(DISTINCT page)) AS p FROM s WHERE kind IN ('JB', 'Tag') GROUP BY 1, 2, 3 HAVING count(DISTINCT page) > 1),
w3 AS (SELECT 'DUPLICATE_' || upper(kind), token, pdf, array_to_string(p, ', '), 0, 'WARNING', kind || ' ''' || token || ''' appears on ' || len(p) || ' pages of ''' || pdf || ''': [' || array_to_string(p, ', ') || '].',
  CASE WHEN kind = 'JB' THEN 'Verify the JB label on each listed page.' ELSE 'Verify the tag is intended to be on multiple pages.' END, NULL, 1 FROM d),
a AS (SELECT token, list_sort(list(DISTINCT pdf)) AS p FROM s WHERE kind = 'Tag' GROUP BY 1 HAVING count(DISTINCT pdf) > 1),
w4 AS (SELECT 'DUPLICATE_TAG', token, array_to_string(p, ','), array_to_string(p, ', '), 0, 'INFO', 'Tag ''' || token || ''' appears in ' || len(p) || ' different PDFs: [''' || array_to_string(p, ''', ''') || '''].', 'Verify the tag is expected across PDFs.', NULL, 1 FROM a),
w AS (SELECT * FROM w1 UNION ALL SELECT * FROM w2 UNION ALL SELECT * FROM w3 UNION ALL SELECT * FROM w4),
once AS (SELECT *, row_number() OVER (PARTITION BY "Warning_Type", "Item", "PDF_Name" ORDER BY class, page) AS k FROM w)"""


@query(f"WITH {SQL_WARNINGS} SELECT * EXCLUDE (page, class, k) FROM once WHERE k = 1")
def k04_u06_warnings_report(spark, sf):
    return reports.warnings_report(_classified(spark, sf))


# Stored runs, issues and logs -------------------------------------------------------------------------------------------------------
RUNS = "SELECT o_orderkey AS id, o_custkey AS project_id, concat('user', CAST(o_custkey % 9 AS STRING)) AS initiated_by, o_totalprice AS price FROM orders"
ISSUES = """
SELECT l_orderkey * 100000000 + l_partkey * 1000 + l_suppkey % 100 * 10 + l_linenumber % 10 AS id, concat('te-', CAST(l_partkey AS STRING)) AS tag, concat('pdf_', CAST(l_orderkey % 10 AS STRING)) AS pdf, l_partkey % 50 AS page, 'OPEN' AS status, CAST(l_shipdate AS TIMESTAMP) AS created_at,
  CASE WHEN l_linenumber = 3 THEN CAST('2030-01-01 00:00:00' AS TIMESTAMP) END AS resolved_at FROM lineitem
"""
SAVED = "SELECT l_orderkey * 1000000 + l_partkey AS id, concat('TE-', CAST(l_partkey AS STRING)) AS tag, concat('pdf_', CAST(l_orderkey % 10 AS STRING)) AS pdf, l_partkey % 50 AS page FROM lineitem WHERE l_quantity > 30"


@query(f"WITH r AS ({RUNS}), p AS (SELECT DISTINCT project_id AS id FROM r UNION SELECT c_custkey FROM customer) SELECT id FROM p WHERE id IN (SELECT project_id FROM r WHERE initiated_by = 'user4') OR id NOT IN (SELECT project_id FROM r)")
def f22_owned_projects(spark, sf):
    projects = A.view(spark, sf, "SELECT c_custkey AS id FROM customer")
    return store.owned_projects(projects, A.view(spark, sf, RUNS), "user4", unstarted=True)


@query("SELECT event_id AS id, user_id, event_type AS action, ts AS created FROM (SELECT *, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS k FROM events WHERE event_type = 'click' AND ts >= (SELECT min(ts) FROM events)) WHERE k <= 100")
def f23_audit(spark, sf):
    log = A.view(spark, sf, "SELECT event_id AS id, user_id, event_type AS action, ts AS created FROM events")
    return store.audit(log, action="click")


@query(f"WITH i AS ({ISSUES}), w AS (SELECT tag, pdf, page, min(id) AS row_id FROM ({SAVED}) x GROUP BY 1, 2, 3) SELECT i.id, row_id FROM i LEFT JOIN w ON upper(i.tag) = w.tag AND i.pdf = w.pdf AND i.page = w.page")
def j18_linked_issues(spark, sf):
    return store.linked(A.view(spark, sf, ISSUES), A.view(spark, sf, SAVED)).select("id", "row_id")


@query(f"WITH r AS ({RUNS}) SELECT l_orderkey AS run_id, concat('/out/', CAST(l_partkey AS STRING)) AS path FROM lineitem JOIN r ON l_orderkey = r.id WHERE initiated_by = 'user4'")
def j20_permitted_artifacts(spark, sf):
    artifacts = A.view(spark, sf, "SELECT l_orderkey AS run_id, concat('/out/', CAST(l_partkey AS STRING)) AS path FROM lineitem")
    return store.permitted(artifacts, A.view(spark, sf, RUNS), "user4")


@query(f"""WITH i AS ({ISSUES}) SELECT id, CASE id % 3 WHEN 0 THEN 'RESOLVED' WHEN 1 THEN 'IGNORED' ELSE status END AS status, CASE WHEN id % 3 = 0 THEN coalesce(resolved_at, created_at) ELSE resolved_at END AS resolved_at FROM i""")
def p06_patched_issues(spark, sf):
    issues = A.view(spark, sf, ISSUES)
    changes = issues.filter("id % 3 < 2").select("id", F.when(F.col("id") % 3 == 0, "RESOLVED").otherwise("IGNORED").alias("new_status"))
    return store.patched(issues, changes).select("id", "status", "resolved_at")


@query(f"WITH r AS ({A.IO_ROWS}) SELECT id, CASE WHEN id % 2 = 0 THEN 'JB-X' WHEN id % 3 = 0 THEN 'b' ELSE jb END AS jb, CASE WHEN id % 5 = 0 THEN status ELSE '' END AS match_status FROM r")
def p05_values_with_fallback(spark, sf):
    given = F.create_map(F.lit("JB"), F.when(F.col("id") % 2 == 0, " JB-X ").otherwise(""), F.lit("jb"), F.when(F.col("id") % 3 == 0, "b"), F.lit("Match"), F.when(F.col("id") % 5 == 0, F.col("status")))
    rows = _rows(spark, sf).select("id", "jb", "status", F.lit(None).cast("string").alias("match_status"), given.alias("values"))
    return store.with_values(rows, "values", {"jb": ["JB", "JB No", "jb"], "match_status": ["Match", "match_status"]}).select("id", "jb", "match_status")
