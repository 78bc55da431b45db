"""Further registered queries: sources, filters, sums, set operations and scalar functions of the instrument operators."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..operators import assign, clean, dims, drawing, match, review, store, textmode
from ..sources import workbooks
from . import adapters as A
from .queries import SQL_EXACT, SQL_INTER, SQL_KIND, SQL_NORMAL, SQL_NUMBERED, SQL_REFS, _assigned, _classified, _clean, _io, _refs, _rows, _spans, _tags, query

PAGES = "SELECT o_orderkey AS pdf, CAST(o_custkey AS BIGINT) AS pages, CAST(floor(o_totalprice) AS BIGINT) % 60 AS chars, (o_orderkey % 10) / CAST(9.0 AS DOUBLE) AS hidden, (o_custkey % 10) / CAST(9.0 AS DOUBLE) AS image FROM orders"


# Sources ------------------------------------------------------------------------------------------------------------------------
@query(f"WITH {SQL_REFS} SELECT reference, ref_seq FROM r")
def s01_reference_scan(spark, sf):
    return _refs(spark, sf)


@query("SELECT o_custkey AS run_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS row_index, CAST(o_orderkey AS STRING) AS tag, o_orderstatus AS io_type FROM orders")
def s02_ingested_rows(spark, sf):
    o = A.view(spark, sf, "SELECT o_custkey AS run_id, CAST(o_orderkey AS STRING) AS `Tag No`, o_orderstatus AS `Signal Type`, o_orderkey AS k FROM orders")
    return workbooks.ingested(o, [F.col("k")], {"tag": ["TAG", "TAG NO"], "io_type": ["I/O TYPE", "SIGNAL TYPE"]}).select("run_id", "row_index", "tag", "io_type")


@query(f"WITH p AS ({PAGES}) SELECT pdf, CASE WHEN chars < 1 THEN 'scanned' WHEN image >= 0.8 AND hidden >= 0.8 THEN 'scanned' WHEN chars >= 30 THEN 'digital' ELSE 'scanned' END AS page_type FROM p")
def s09_page_types(spark, sf):
    return A.view(spark, sf, PAGES).select("pdf", workbooks.page_type(F.col("chars"), F.col("hidden"), F.col("image")).alias("page_type"))


@query(f"WITH p AS ({PAGES}), t AS (SELECT pages AS pdf, CASE WHEN chars < 1 THEN 'scanned' WHEN image >= 0.8 AND hidden >= 0.8 THEN 'scanned' WHEN chars >= 30 THEN 'digital' ELSE 'scanned' END AS t FROM p) SELECT pdf, CASE WHEN count(*) FILTER (t = 'digital') > count(*) FILTER (t = 'scanned') THEN 'digital' ELSE 'scanned' END AS pdf_type FROM t GROUP BY pdf")
def s10_document_types(spark, sf):
    p = A.view(spark, sf, PAGES).select(F.col("pages").alias("pdf"), workbooks.page_type(F.col("chars"), F.col("hidden"), F.col("image")).alias("page_type"))
    return workbooks.document_type(p)


@query(f"WITH p AS ({PAGES}) SELECT pdf, array_to_string(list_sort(list_distinct([0, pages // 2, pages - 1] || [0, pages // 5, 2 * pages // 5, 3 * pages // 5, 4 * pages // 5]))[1:5], ',') AS sample, CASE WHEN pages > 300 THEN 150 WHEN pages > 100 THEN 200 ELSE 300 END AS dpi FROM p WHERE pages > 0")
def s11_s20_samples_and_dpi(spark, sf):
    p = A.view(spark, sf, PAGES).filter("pages > 0")
    return p.select("pdf", F.array_join(F.transform(workbooks.sample_indices(F.col("pages"), 5), lambda i: i.cast("string")), ",").alias("sample"), workbooks.effective_dpi(F.col("pages")).alias("dpi"))


@query("SELECT c_name, sha256(c_name) AS hash FROM customer")
def s04_x25_hashes(spark, sf):
    return A.view(spark, sf, "SELECT c_name FROM customer").select("c_name", F.sha2("c_name", 256).alias("hash"))


# Cleaning and filters -------------------------------------------------------------------------------------------------------------
def _section(name, sql, cond):
    def rows(spark, sf):
        return clean.normalised(_io(spark, sf)).filter(cond()).select("seq", "safety_raw", "location_raw", "location")

    rows.__name__ = name
    return query(f"WITH {SQL_NORMAL} SELECT seq, safety AS safety_raw, location AS location_raw, place AS location FROM n WHERE {sql}")(rows)


f02_missing_critical = _section("f02_missing_critical", "rejected = 'missing'", lambda: F.col("rejected") == "missing")
f03_invalid_jb = _section("f03_invalid_jb", "rejected = 'invalid_jb'", lambda: F.col("rejected") == "invalid_jb")
f05_safety_conversion = _section("f05_safety_conversion", "(rejected IS NULL OR rejected = 'invalid_safety') AND safety IS DISTINCT FROM safe", lambda: (F.col("rejected").isNull() | (F.col("rejected") == "invalid_safety")) & ~F.col("safety_raw").eqNullSafe(F.col("safety")))
f06_location_imputed = _section("f06_location_imputed", "rejected IS NULL AND loc IS NULL", lambda: F.col("rejected").isNull() & F.col("imputed"))
f08_logical_exceptions = _section("f08_logical_exceptions", "rejected IS NULL AND ion IN ('AI', 'AO') AND place = 'MCC'", lambda: F.col("rejected").isNull() & F.col("io").isin("AI", "AO") & (F.col("location") == "MCC"))


@query("SELECT event_id, greatest(coalesce(TRY_CAST(event_type AS DOUBLE), TRY_CAST(CAST(event_id AS STRING) AS DOUBLE) - 50), 0) AS spares FROM events")
def f09_spare_counts(spark, sf):
    e = A.view(spark, sf, "SELECT event_id, event_type, CAST(event_id - 50 AS STRING) AS n FROM events")
    return e.withColumn("t", F.coalesce(F.when(F.col("event_type").try_cast("double").isNotNull(), F.col("event_type")), "n")).select("event_id", clean.spare_count("t").alias("spares"))


@query(f"WITH {SQL_KIND} SELECT DISTINCT text, kind <> 'Tag' AS non_tag FROM s WHERE kind IN ('Tag', 'JB', 'MC', 'SPARE', 'Cable') OR text LIKE '02-%'")
def f19_non_tags(spark, sf):
    return _spans(spark, sf).select("text", drawing.non_tag(F.col("text")).alias("non_tag")).distinct()


@query(f"WITH r AS ({A.IO_ROWS}) SELECT id, status FROM r WHERE status IN ('1-URGENT', '2-HIGH') AND jb = 'JB-3'")
def f21_issue_filter(spark, sf):
    return _rows(spark, sf).filter(F.col("status").isin("1-URGENT", "2-HIGH") & (F.col("jb") == "JB-3")).select("id", "status")


# Joins --------------------------------------------------------------------------------------------------------------------------
@query(f"WITH {SQL_KIND}, {SQL_INTER}, sp AS (SELECT upper(trim(jb)) AS k, count(*) AS n FROM inter WHERE type = 'SPARE' GROUP BY 1), io AS ({A.IO_SIGNALS}) SELECT io.seq, coalesce(sp.n, 0) AS spare_count FROM io LEFT JOIN sp ON upper(trim(io.jb)) = sp.k")
def j04_spare_counts_on_rows(spark, sf):
    spares = drawing.intermediate(_classified(spark, sf)).filter("type = 'SPARE'").groupBy(F.upper(F.trim("jb")).alias("k")).agg(F.count("*").alias("n"))
    io = _io(spark, sf).select("seq", F.upper(F.trim("jb")).alias("k"))
    return io.join(spares, "k", "left").select("seq", F.coalesce("n", F.lit(0)).alias("spare_count"))


@query(f"WITH {SQL_KIND}, {SQL_EXACT} SELECT reference AS tag FROM r WHERE reference NOT IN (SELECT reference FROM exact WHERE reference IS NOT NULL)")
def j08_u03_missing_references(spark, sf):
    refs = _refs(spark, sf)
    hit = match.exact(_tags(spark, sf), refs).filter("reference is not null").select("reference")
    return refs.join(hit, "reference", "left_anti").select(F.col("reference").alias("tag"))


@query(f"WITH r AS ({A.IO_ROWS}), l AS ({A.RUN_LOG}) SELECT DISTINCT run_id FROM r WHERE run_id IN (SELECT run_id FROM l)")
def j19_projects_with_runs(spark, sf):
    return _rows(spark, sf).select("run_id").distinct().join(A.view(spark, sf, A.RUN_LOG).select("run_id"), "run_id", "left_semi")


@query(f"WITH w AS (SELECT o_custkey AS page, 1 AS line, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS word_no, o_orderstatus AS text FROM orders), p AS (SELECT a.page, a.line, a.word_no, 2 AS n, a.text || b.text AS text FROM w a JOIN w b ON a.page = b.page AND b.word_no = a.word_no + 1 UNION ALL SELECT a.page, a.line, a.word_no, 3 AS n, a.text || b.text || c.text AS text FROM w a JOIN w b ON a.page = b.page AND b.word_no = a.word_no + 1 JOIN w c ON a.page = c.page AND c.word_no = a.word_no + 2) SELECT * FROM p")
def j17_word_runs(spark, sf):
    return textmode.neighbours(A.view(spark, sf, "SELECT o_custkey AS page, 1 AS line, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS word_no, o_orderstatus AS text FROM orders"))


# Aggregations -----------------------------------------------------------------------------------------------------------------------
@query(f"WITH {SQL_NORMAL} SELECT jb, max(jb_key % 4) AS capacity FROM c GROUP BY jb")
def a03_spare_capacity(spark, sf):
    return _clean(spark, sf).groupBy("jb").agg(F.max(F.col("jb_key") % 4).alias("capacity"))


@query()
def a11_a12_cabinet_stats(spark, sf):
    signals, _, packed = _assigned(spark, sf)
    return assign.cabinet_stats(assign.allocate(signals, packed))


@query(f"WITH {SQL_KIND}, {SQL_EXACT} SELECT count(*) AS tags, count(reference) AS matched, round_even(100.0 * count(reference) / count(*), 2) AS rate FROM exact")
def a14_a18_match_rate(spark, sf):
    e = match.exact(_tags(spark, sf), _refs(spark, sf)).agg(F.count("*").alias("tags"), F.count("reference").alias("matched"))
    return e.select("tags", "matched", textmode.match_rate(F.col("matched"), F.col("tags")).alias("rate"))


@query(f"WITH {SQL_KIND} SELECT pdf, count(DISTINCT page) AS pages, count(*) FILTER (kind = 'Tag') AS matches, count(DISTINCT token) FILTER (kind = 'Tag') AS tags FROM s GROUP BY pdf")
def a17_pdf_stats(spark, sf):
    tag = F.when(F.col("kind") == "Tag", F.col("token"))
    return _classified(spark, sf).groupBy("pdf").agg(F.countDistinct("page").alias("pages"), F.count(tag).alias("matches"), F.countDistinct(tag).alias("tags"))


@query(f"WITH {SQL_KIND}, {SQL_INTER} SELECT pdf, page, max(number) AS highest, count(DISTINCT number) = max(number) AS consistent FROM inter GROUP BY pdf, page")
def a23_number_consistency(spark, sf):
    return drawing.number_consistency(drawing.intermediate(_classified(spark, sf)))


NO_PAIR, NO_NUMBER = "WARNING: Could not extract pair number from cable description", "WARNING: No tag numbers found"
PAIRS = "SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'CBL' ELSE concat(CAST(p_size AS STRING), ' PAIR') END AS cable, CAST(CASE p_partkey % 3 WHEN 0 THEN p_size WHEN 1 THEN 0 ELSE 7 END AS INT) AS highest FROM part"


@query(f"WITH p AS ({PAIRS}), n AS (SELECT *, CAST(nullif(regexp_extract(cable, '([0-9]+) PAIR', 1), '') AS INT) AS pair FROM p) SELECT p_partkey, pair, CASE WHEN pair IS NULL THEN '{NO_PAIR}' WHEN highest = 0 THEN '{NO_NUMBER}' WHEN pair = highest THEN 'OK' ELSE concat('WARNING: Pair number (', pair, ') != Max Tag number (', highest, ')') END AS status FROM n")
def a30_pair_status(spark, sf):
    p = A.view(spark, sf, PAIRS).withColumn("pair", X.pair_number(F.col("cable")))
    return p.select("p_partkey", "pair", drawing.pair_status(F.col("pair"), F.col("highest")).alias("status"))


@query(f"WITH {SQL_KIND}, {SQL_NUMBERED}, h AS (SELECT pdf, page, max(number) FILTER (kind = 'Tag') AS highest FROM numbered GROUP BY pdf, page), p AS (SELECT DISTINCT pdf, page FROM s) SELECT p.pdf, p.page, CAST(NULL AS INT) AS pair, highest, '{NO_PAIR}' AS status FROM p LEFT JOIN h ON p.pdf = h.pdf AND p.page = h.page")
def a22_pair_consistency(spark, sf):
    return drawing.pair_consistency(_classified(spark, sf))


TEXTS = ["SPARE", "2 SPARE", "SPARE 3", "12 spare 3 4", "SPARE 3 5 x", "x3 SPARE 5", "101 SPARE", " 7  SPARE", "SPARES 4", "a 4SPARE", "TE-5223", "PT-1014-A", "fv-2233 1", "FV-2233 1", " FV-2233  12 ", "FV-2233 1234", "JB-12", "JM506", "1201JM506", "XJM506", "NOTE", "data Table", "line diagram", "IP65", ""]
SQL_TEXTS = "SELECT p_partkey, t AS text FROM part JOIN (VALUES " + ", ".join(f"({k}, '{t}')" for k, t in enumerate(TEXTS)) + f") v(k, t) ON p_partkey % {len(TEXTS)} = k"
SPARE_SQL = "(?is)^(.*?)\\bSPARE(?:\\s*[0-9]+)?\\b(.*)$"


@query(f"WITH v AS ({SQL_TEXTS}) SELECT p_partkey, CAST(coalesce(nullif(regexp_extract(regexp_extract(text, '{SPARE_SQL}', 1), '(?:^|\\s)([0-9]{{1,2}})\\s*$', 1), ''), nullif(regexp_extract(regexp_extract(text, '{SPARE_SQL}', 2), '^\\s*([0-9]{{1,2}})(?:\\s|$)', 1), '')) AS INT) AS spares FROM v")
def x24_written_spares(spark, sf):
    return A.view(spark, sf, SQL_TEXTS).select("p_partkey", drawing.written_spares(F.col("text")).alias("spares"))


@query(f"WITH v AS ({SQL_TEXTS}) SELECT p_partkey, CASE WHEN regexp_matches(text, '(?i)^\\s*FV-2233\\s+[0-9]{{1,3}}\\s*$') THEN concat('FV-2233 ', regexp_extract(text, '([0-9]+)\\s*$', 1)) ELSE 'FV-2233' END AS tag, CASE WHEN text LIKE 'JM%' THEN concat('1201', text) ELSE text END AS jb, CASE WHEN lower(text) LIKE '%table%' THEN 'table' ELSE 'diagrams' END AS label FROM v")
def x21_x22_x27_texts(spark, sf):
    c = F.col("text")
    return A.view(spark, sf, SQL_TEXTS).select("p_partkey", drawing.with_spaced_suffix(c, F.lit("FV-2233")).alias("tag"), drawing.with_area_prefix(c, ["JB", "1201JM", "77JM"]).alias("jb"), drawing.document_label(c).alias("label"))


@query("WITH c AS (SELECT doc_id, coalesce(length(text), 0) AS n, coalesce(length(text) - length(regexp_replace(text, '[^\\t-\\r\\x1c-\\x1f\\x{85}\\P{C}]|\\x{FFFD}', '', 'g')), 0) AS broken, coalesce(regexp_matches(text, '[\\p{L}\\p{N}]'), false) AS filled FROM documents) SELECT doc_id, filled AND broken <= 0.05 * n AS usable FROM c")
def f18_usable_texts(spark, sf):
    pages = A.view(spark, sf, "SELECT doc_id AS pdf, doc_id AS page, text FROM documents")
    return drawing.usable_pages(pages).select(F.col("pdf").alias("doc_id"), "usable")


@query(f"WITH {SQL_KIND}, n AS (SELECT pdf, page, count(*) AS labels FROM s WHERE kind = 'SPARE' GROUP BY pdf, page) SELECT s.pdf, s.page, seq, 1 AS spares FROM s JOIN n ON s.pdf = n.pdf AND s.page = n.page WHERE kind = 'SPARE'")
def x24_spare_counts(spark, sf):
    return drawing.spare_counts(_classified(spark, sf))


@query(f"WITH l AS ({A.RUN_LOG}), g AS (SELECT run_id, level, count(*) AS n FROM l GROUP BY run_id, level), k AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY n DESC, level DESC) AS k FROM g) SELECT run_id, level AS label FROM k WHERE k = 1")
def a24_majority(spark, sf):
    n = A.view(spark, sf, A.RUN_LOG).groupBy("run_id", "level").agg(F.count("*").alias("n"))
    return n.groupBy("run_id").agg(F.max_by("level", F.struct("n", "level")).alias("label"))


# Windows, order, sets ------------------------------------------------------------------------------------------------------------
@query(f"WITH r AS ({A.IO_ROWS}) SELECT id, CASE WHEN row_index < max(row_index) OVER (PARTITION BY run_id) THEN 'ARCHIVED' ELSE status END AS status FROM r")
def w12_keep_latest(spark, sf):
    last = F.max("row_index").over(Window.partitionBy("run_id"))
    return _rows(spark, sf).select("id", F.when(F.col("row_index") < last, "ARCHIVED").otherwise(F.col("status")).alias("status"))


@query(f"WITH r AS ({A.IO_ROWS}) SELECT id, (row_index - 1) % 6 AS colour FROM r")
def w13_colour_cycle(spark, sf):
    return _rows(spark, sf).select("id", F.pmod(F.col("row_index") - 1, F.lit(6)).alias("colour"))


@query(f"WITH {SQL_KIND}, {SQL_INTER} SELECT item, arg_max(number, page * 1000 + number) AS number FROM inter WHERE type = 'Tag' GROUP BY item")
def u10_last_page_wins(spark, sf):
    return drawing.intermediate(_classified(spark, sf)).filter("type = 'Tag'").groupBy("item").agg(F.max_by("number", F.struct("page", "number")).alias("number"))


@query(f"WITH {SQL_KIND} SELECT DISTINCT kind, token FROM s WHERE kind IN ('JB', 'MC')")
def u05_run_level_sets(spark, sf):
    return _classified(spark, sf).filter("kind in ('JB', 'MC')").select("kind", "token").distinct()


@query(f"WITH {SQL_KIND}, w AS (SELECT pdf, page, count(DISTINCT token) FILTER (kind = 'JB') AS b, count(*) FILTER (kind IN ('Tag', 'SPARE')) AS i FROM s GROUP BY pdf, page), v AS (SELECT CASE WHEN b > 1 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, pdf, page FROM w WHERE b > 1 OR (b = 0 AND i > 0)), k AS (SELECT *, row_number() OVER (PARTITION BY pdf ORDER BY CASE severity WHEN 'HIGH' THEN 0 ELSE 1 END, page) AS place FROM v) SELECT * FROM k")
def o09_severity_order(spark, sf):
    place = F.row_number().over(Window.partitionBy("pdf").orderBy(review.severity_rank(F.col("severity")), "page"))
    return drawing.warnings(_classified(spark, sf)).select("severity", "pdf", "page").withColumn("place", place)


# Scalars ----------------------------------------------------------------------------------------------------------------------------
@query(f"WITH {SQL_NORMAL} SELECT DISTINCT io_type, io_key FROM k")
def x01_io_keys(spark, sf):
    return _io(spark, sf).select("io_type", X.io_key(F.col("io_type")).alias("io_key")).distinct()


@query(f"WITH {SQL_REFS} SELECT reference, regexp_replace(reference, '[\\s_-]+', '', 'g') AS key, regexp_extract(reference, '^([A-Z]+)', 1) AS prefix FROM r")
def x02_x11_reference_keys(spark, sf):
    return _refs(spark, sf).select("reference", X.separator_key(F.col("reference")).alias("key"), F.regexp_extract("reference", "^([A-Z]+)", 1).alias("prefix"))


@query("SELECT c_custkey, regexp_extract(c_name, '^(.*?)([0-9]+)$', 1) AS prefix, CAST(regexp_extract(c_name, '^(.*?)([0-9]+)$', 2) AS BIGINT) AS number, length(regexp_extract(c_name, '^(.*?)([0-9]+)$', 2)) AS width, c_name AS again FROM customer WHERE regexp_matches(c_name, '[0-9]$')")
def x14_x15_terminals(spark, sf):
    c = A.view(spark, sf, "SELECT c_custkey, c_name FROM customer").withColumn("t", X.terminal_parts(F.col("c_name"))).filter("t is not null")
    return c.select("c_custkey", "t.prefix", "t.number", "t.width", X.terminal(F.col("t.prefix"), F.col("t.number"), F.col("t.width")).alias("again"))


@query("SELECT s_suppkey, upper(trim(coalesce(s_name, ''))) AS jb, left(trim(s_name), 5) AS cut, lower(regexp_replace(trim(s_name), '\\s+', ' ', 'g')) AS project FROM supplier")
def x16_x17_x19_names(spark, sf):
    s = A.view(spark, sf, "SELECT s_suppkey, s_name FROM supplier")
    return s.select("s_suppkey", X.upper_trim(F.col("s_name")).alias("jb"), X.truncated(F.col("s_name"), 5).alias("cut"), F.lower(F.regexp_replace(F.trim("s_name"), r"\s+", " ")).alias("project"))


@query("SELECT p_partkey, CAST(p_size AS STRING) || ' pair' AS unit, p_size AS pairs FROM part")
def x13_x23_cable_units(spark, sf):
    p = A.view(spark, sf, "SELECT p_partkey, concat('FRS-', CAST(p_size AS STRING), 'P x 1.5mm2') AS t FROM part")
    return p.select("p_partkey", X.cable_unit(F.col("t")).alias("unit"), X.pair_number(F.col("t")).alias("pairs"))


@query("SELECT o_orderkey, TRY_CAST(trim(o_orderpriority) AS INT) AS bad, TRY_CAST(trim(left(o_orderpriority, 1)) AS INT) AS good FROM orders")
def m13_safe_int(spark, sf):
    o = A.view(spark, sf, "SELECT o_orderkey, o_orderpriority FROM orders")
    return o.select("o_orderkey", F.trim("o_orderpriority").try_cast("int").alias("bad"), F.trim(F.left("o_orderpriority", F.lit(1))).try_cast("int").alias("good"))


@query("SELECT p_partkey, CASE WHEN floor(floor(CAST(100 AS DOUBLE) / (1 + p_size)) / 2) > 0 THEN round_even(CAST(1339 AS DOUBLE) / floor(floor(CAST(100 AS DOUBLE) / (1 + p_size)) / 2) - 2, 1) END AS height FROM part")
def h27_m07_reverse(spark, sf):
    p = A.view(spark, sf, "SELECT p_partkey, CAST(1 + p_size AS DOUBLE) AS share FROM part")
    d = lambda x: F.lit(float(x))
    return p.select("p_partkey", dims.height_from_share(F.col("share"), d(1711), d(52), d(20), d(300), d(2), F.lit(2)).alias("height"))


@query(f"WITH r AS ({A.IO_ROWS}) SELECT id, jb AS merged_jb, 'DONE' AS merged_status FROM r")
def c01_c03_maps(spark, sf):
    r = _rows(spark, sf).select("id", F.create_map(F.lit("jb"), F.col("jb"), F.lit("status"), F.col("status")).alias("old"), F.create_map(F.lit("status"), F.lit("DONE")).alias("new"))
    m = r.withColumn("m", review.merged(F.col("old"), F.col("new")))
    return m.select("id", review.first_present(F.col("m"), ["box", "jb"]).alias("merged_jb"), F.col("m")["status"].alias("merged_status"))


@query(f"WITH {SQL_KIND}, {SQL_EXACT}, u AS (SELECT tag FROM exact WHERE reference IS NULL AND upper(tag) NOT LIKE 'NC%') SELECT tag, 'FFF2CC' AS row_color FROM u")
def k05_row_colours(spark, sf):
    return match.unmatched(_tags(spark, sf), _refs(spark, sf)).filter("source = 'PDF'").select("tag", F.lit("FFF2CC").alias("row_color"))


# Store --------------------------------------------------------------------------------------------------------------------------
@query("SELECT n_name AS name, sha256(n_name) AS hash FROM nation UNION ALL SELECT DISTINCT c_mktsegment AS name, sha256(c_mktsegment) AS hash FROM customer WHERE c_mktsegment NOT IN (SELECT n_name FROM nation)")
def p01_get_or_create(spark, sf):
    projects = A.view(spark, sf, "SELECT n_name AS name, sha2(n_name, 256) AS hash FROM nation")
    return store.get_or_create(projects, A.view(spark, sf, "SELECT c_mktsegment AS name FROM customer"))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'O' THEN 'DONE' ELSE o_orderstatus END AS status, CAST(NULL AS TIMESTAMP) AS started_at, CASE WHEN o_orderstatus = 'O' THEN coalesce(CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate END, TIMESTAMP '2025-01-01 00:00:00') END AS finished_at FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT o_orderkey, o_orderstatus, NULL, CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate END FROM orders WHERE o_orderstatus <> 'O'")
def p02_run_status(spark, sf):
    runs = A.view(spark, sf, "SELECT o_orderkey AS id, o_orderstatus AS status, CAST(NULL AS TIMESTAMP) AS started_at, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderdate AS TIMESTAMP) END AS finished_at FROM orders")
    changes = runs.filter("status = 'O'").select("id", F.lit("DONE").alias("new_status"))
    return store.with_status(runs, changes, F.lit("2025-01-01 00:00:00").cast("timestamp"))


@query(f"WITH r AS ({A.IO_ROWS}), n AS (SELECT DISTINCT run_id, CAST(1 AS BIGINT) AS row_index, 'NEW' AS jb FROM r WHERE status = '1-URGENT') SELECT run_id, CAST(row_index AS BIGINT) AS row_index, jb FROM r WHERE run_id NOT IN (SELECT run_id FROM n) UNION ALL SELECT * FROM n")
def k15_persist_run(spark, sf):
    rows = _rows(spark, sf)
    new = rows.filter("status = '1-URGENT'").select("run_id", F.lit(1).cast("bigint").alias("row_index"), F.lit("NEW").alias("jb")).distinct()
    return store.persisted(rows.select("run_id", F.col("row_index").cast("bigint").alias("row_index"), "jb"), new)


@query(f"WITH r AS ({A.IO_ROWS}), a AS (SELECT DISTINCT run_id, jb, 'detail' AS class FROM r WHERE status = '1-URGENT'), b AS (SELECT DISTINCT run_id, jb, 'candidate' AS class FROM r WHERE status = '2-HIGH') SELECT * FROM a UNION ALL SELECT * FROM b WHERE (run_id, jb) NOT IN (SELECT (run_id, jb) FROM a)")
def u07_issue_classes(spark, sf):
    of = lambda status, name: _rows(spark, sf).filter(F.col("status") == status).select("run_id", "jb", F.lit(name).alias("class")).distinct()
    return store.issues([of("1-URGENT", "detail"), of("2-HIGH", "candidate")], ["run_id", "jb"])


@query(f"WITH {SQL_KIND}, d AS (SELECT 'dup' AS warning, token AS item, pdf, page, row_number() OVER (PARTITION BY upper(token), upper(pdf) ORDER BY page, seq) AS k FROM s WHERE kind = 'JB') SELECT warning, item, pdf, page FROM d WHERE k = 1")
def a09_warning_dedup(spark, sf):
    return store.deduplicated_warnings(_classified(spark, sf).filter("kind = 'JB'").select(F.lit("dup").alias("warning"), F.col("token").alias("item"), "pdf", "page"))


@query(f"WITH {SQL_KIND}, k AS (SELECT *, row_number() OVER (PARTITION BY pdf, page, kind = 'Cable' ORDER BY length(regexp_replace(token, '[^0-9]', '', 'g')) DESC, token, y, x, seq) AS k FROM s WHERE kind <> 'Unknown') SELECT pdf, page, kind, token, CASE kind WHEN 'JB' THEN '0000FF' WHEN 'MC' THEN '800080' WHEN 'SPARE' THEN 'FFA500' WHEN 'Tag' THEN '00AA00' ELSE 'A52A2A' END AS colour, x * CAST(72 AS DOUBLE) / 300 AS x0, (y + h) * CAST(72 AS DOUBLE) / 300 AS y1 FROM k WHERE kind <> 'Cable' OR k = 1")
def k09_m14_annotation_plan(spark, sf):
    return store.annotation_plan(_classified(spark, sf)).select("pdf", "page", "kind", "token", "colour", F.col("box.x0").alias("x0"), F.col("box.y1").alias("y1"))


@query(f"WITH r AS ({A.IO_ROWS}) SELECT row_index, id, CASE WHEN row_index > 1 THEN jb ELSE 'X' END AS jb FROM r")
def k17_export_backfill(spark, sf):
    rows = _rows(spark, sf).withColumn("values", F.create_map(F.lit("id"), F.col("id").cast("string"), F.lit("jb"), F.when(F.col("row_index") > 1, "").otherwise("X")))
    columns = store.composed_columns(["id"], ["jb"], ["id", "jb"], [])
    return store.exported(rows, columns, {"jb": "jb"}).select("row_index", F.col("id").cast("bigint").alias("id"), "jb")
