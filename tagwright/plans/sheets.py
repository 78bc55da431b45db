"""A view of drawings whose spans hold names of several projects, counts beside labels and cables in parts, and the queries over it."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType
from pyspark.sql.window import Window

from ..functions import text as X
from ..operators import catalogue, drawing, match, recovery, spatial, store, textmode
from ..sources import fonts, guarded
from ..sources.tables import stored
from . import adapters as A
from .queries import SHIFTED_REFERENCE, SQL_EXACT, SQL_KIND, SQL_NUMBERED, _refs, _tags, query

_N, _S, _SEQ = "l_partkey", "CAST(100 + l_partkey % 900 AS STRING)", "l_partkey * 100000 + l_suppkey % 10000 * 10 + l_linenumber"
SHEETS = f"""
SELECT concat('pdf_', CAST(l_orderkey % 10 AS STRING)) AS pdf, l_orderkey AS page, {_SEQ} AS seq, CAST(100 + l_partkey * 7 % 400 AS INT) AS x, CAST(100 + 37 * l_linenumber + l_suppkey % 23 AS INT) AS y,
  CAST(20 + l_partkey % 41 AS INT) AS w, 12 AS h, CAST(0.9 AS DOUBLE) AS confidence, CAST(l_partkey AS BIGINT) AS n,
  CASE l_linenumber
    WHEN 1 THEN CASE {_N} % 6 WHEN 0 THEN concat('JB-', {_S}) WHEN 1 THEN concat('JSF-', {_S}) WHEN 2 THEN concat('12JB ', {_S}) WHEN 3 THEN concat('JB To ITR ', {_S}) WHEN 4 THEN concat('1201JM-', {_S}) ELSE concat('jm-', {_S}, 'A') END
    WHEN 2 THEN CASE {_N} % 4 WHEN 0 THEN concat('MC-', {_S}) WHEN 1 THEN concat('NC-JSF-', {_S}, 'S') WHEN 2 THEN concat('NC ', {_S}) ELSE concat('IC-EEV-', {_S}) END
    WHEN 3 THEN CASE {_N} % 6 WHEN 0 THEN concat(CAST(2 + l_partkey % 30 AS STRING), ' PAIR') WHEN 1 THEN concat(CAST(2 + l_partkey % 30 AS STRING), 'P x 1.5 MM2') WHEN 2 THEN '7 CORE' WHEN 3 THEN 'NC-0-1-2-C-3-BL' WHEN 4 THEN '3 TRIPLE' ELSE CAST(2 + l_partkey % 30 AS STRING) END
    WHEN 4 THEN CASE {_N} % 3 WHEN 0 THEN 'PAIR' WHEN 1 THEN '24PR' ELSE 'CBL-5-6' END
    WHEN 5 THEN CASE {_N} % 5 WHEN 0 THEN 'SPARE' WHEN 1 THEN 'SPARES' WHEN 2 THEN '3 SPARE' WHEN 3 THEN 'SPARE 2' ELSE 'RESERVE' END
    WHEN 6 THEN CASE {_N} % 2 WHEN 0 THEN CAST(1 + l_partkey % 9 AS STRING) ELSE concat('TE-', {_S}) END
    ELSE CASE {_N} % 5 WHEN 0 THEN concat('TE-', {_S}, '-A') WHEN 1 THEN concat('FV-', CAST(1000 + l_partkey % 9000 AS STRING), ' 1') WHEN 2 THEN '02-JUL-2025' WHEN 3 THEN 'IP65' ELSE concat('te_', {_S}) END END AS text
FROM lineitem
"""
BY_AREA = catalogue.Catalogue(boxes=["12JB", "1201JM"], motors="MC, NC", spares=["SPARE"], cables="12P; 7 CORE")
BY_NAME = catalogue.Catalogue(boxes="JSF IC", motors=["NC"], spares="RESERVE")
BOXES_ALONE = catalogue.Catalogue(motors=[], spares="", cables=[])


def _sheets(spark: SparkSession, sf: str) -> DataFrame:
    return A.view(spark, sf, SHEETS)


def _by_area(spark: SparkSession, sf: str) -> DataFrame:
    return stored(catalogue.classified(_sheets(spark, sf), BY_AREA))


def _kinds(spark: SparkSession, sf: str, given: catalogue.Catalogue) -> DataFrame:
    return catalogue.classified(_sheets(spark, sf), given).groupBy("text", "kind", "token").agg(F.count("*").alias("n"))


def _sql_kinds(rows: list[tuple[str, str, str]]) -> str:
    """The kinds of the view's texts, by their form; u is the upper-cased text."""
    when = " ".join(f"WHEN {form} THEN ['{kind}', {token}]" for form, kind, token in rows)
    return f"kinds AS (SELECT *, k[1] AS kind, k[2] AS token FROM (SELECT *, upper(text) AS u, CASE {when} ELSE ['Unknown', upper(text)] END AS k FROM ({SHEETS}) v0) v1)"


# Forms that every catalogue reads alike: tags, dates, ratings.
_TAGS = [("upper(text) LIKE 'TE-%' OR upper(text) LIKE 'FV-%'", "Tag", "upper(text)"), ("upper(text) LIKE 'TE!_%' ESCAPE '!'", "Tag", "replace(upper(text), '_', '-')")]
SQL_BY_AREA = _sql_kinds([
    ("text LIKE 'JB-%'", "JB", "'12' || text"), ("text LIKE '12JB %'", "JB", "replace(text, ' ', '')"), ("text LIKE '1201JM-%'", "JB", "text"), ("text LIKE 'jm-%'", "JB", "'1201' || upper(text)"),
    ("text LIKE 'MC-%' OR text LIKE 'NC-%'", "MC", "text"), ("text LIKE 'NC %'", "MC", "replace(text, ' ', '')"), ("text LIKE 'JSF-%'", "Tag", "text"), ("text LIKE 'IC-EEV-%'", "Tag", "text[4:]"),
    ("text IN ('SPARE', 'SPARES', '3 SPARE', 'SPARE 2')", "SPARE", "'SPARE'"), ("text LIKE '% PAIR'", "Cable", "split_part(text, ' ', 1) || ' pair'"), ("text LIKE '%P x 1.5 MM2'", "Cable", "split_part(text, 'P', 1) || ' pair'"),
    ("text = '24PR'", "Cable", "'24 pair'"), ("text = '7 CORE'", "Cable", "'7 core'"), *_TAGS,
])
SQL_BY_NAME = _sql_kinds([
    ("text LIKE 'JSF-%' OR text LIKE 'IC-EEV-%'", "JB", "text"), ("text LIKE 'NC-%'", "MC", "text"), ("text LIKE 'NC %'", "MC", "replace(text, ' ', '')"),
    ("text LIKE 'JB-%' OR text LIKE 'MC-%'", "Tag", "text"), ("text LIKE 'jm-%'", "Tag", "upper(text)"), ("text = 'RESERVE'", "SPARE", "text"), ("text = 'CBL-5-6'", "Cable", "text"), *_TAGS,
])
SQL_BOXES_ALONE = _sql_kinds([
    ("text LIKE 'JB-%'", "JB", "text"), ("text LIKE 'JSF-%' OR text LIKE 'MC-%'", "Tag", "text"), ("text LIKE 'NC-JSF-%' OR text LIKE 'IC-EEV-%'", "Tag", "text[4:]"), ("text LIKE 'jm-%'", "Tag", "upper(text)"), *_TAGS,
])
_COUNTED = "SELECT text, kind, token, count(*) AS n FROM kinds GROUP BY text, kind, token"


# Kinds by a project's examples ----------------------------------------------------------------------------------------------------
@query(f"WITH {SQL_BY_AREA} {_COUNTED}")
def t08_x22_kinds_by_area(spark, sf):
    return _kinds(spark, sf, BY_AREA)


@query(f"WITH {SQL_BY_NAME} {_COUNTED}")
def t08_kinds_by_name(spark, sf):
    return _kinds(spark, sf, BY_NAME)


@query(f"WITH {SQL_BOXES_ALONE} {_COUNTED}")
def t09_explicitly_empty(spark, sf):
    return _kinds(spark, sf, BOXES_ALONE)


@query(f"""WITH v AS (SELECT DISTINCT text, upper(text) AS u FROM ({SHEETS}) x)
SELECT text, regexp_full_match(u, '12JB [0-9]+|JB-[0-9]+|1201JM-[0-9]+|JM-[0-9]+A') AS box, regexp_full_match(u, 'MC-[0-9]+|NC-JSF-[0-9]+S|NC [0-9]+|NC-0-1-2-C-3-BL') AS motor,
  u IN ('SPARE', 'SPARES', '3 SPARE', 'SPARE 2') AS spare, regexp_full_match(u, '[0-9]+ PAIR|[0-9]+P X 1.5 MM2|24PR|7 CORE') AS cable FROM v""")
def t10_token_predicates(spark, sf):
    t = F.col("text")
    of = {"box": catalogue.is_box, "motor": catalogue.is_motor, "spare": catalogue.is_spare, "cable": catalogue.is_cable}
    return _sheets(spark, sf).select("text").distinct().select("text", *(f(t, BY_AREA).alias(k) for k, f in of.items()))


# Spans by place -------------------------------------------------------------------------------------------------------------------
@query(f"""WITH {SQL_BY_AREA}, w(win, l, r, v) AS (VALUES (1, 40, 180, 100), (2, 120, 300, 130), (3, 220, 380, 170)),
met AS (SELECT m.pdf, m.page, m.seq, m.token AS motor, c.seq AS cable_seq, c.token AS cable, win, abs(c.x - m.x) + 3 * abs(c.y - m.y) + CASE WHEN c.y < m.y THEN 40 ELSE 0 END AS distance, length(c.text) AS size, c.y, c.x
  FROM kinds m JOIN kinds c ON m.pdf = c.pdf AND m.page = c.page AND m.kind = 'MC' AND c.kind = 'Cable' JOIN w ON c.x - m.x BETWEEN -l AND r AND abs(c.y - m.y) <= v),
first AS (SELECT *, row_number() OVER (PARTITION BY pdf, page, seq ORDER BY win, distance, size, y, x, cable_seq) AS r FROM met)
SELECT pdf, page, seq, motor, cable_seq, cable, win AS "window", distance FROM first WHERE r = 1""")
def j11_nearest_cables(spark, sf):
    return spatial.nearest_cables(_by_area(spark, sf))


_UNIT = r"(?:^|[^A-Z0-9])(?:[A-Z]{2,8}[-_ ]*)?([0-9]{1,3})\s*(P(?:AIR|R)?|C(?:ORE|R)?)(?:\s*X\s*[0-9]+(?:\.[0-9]+)?\s*(?:MM\s*2?)?)?(?:[^A-Z0-9]|$)"


@query(f"""WITH {SQL_BY_AREA}, near AS (SELECT m.seq AS motor_seq, s.* FROM kinds m JOIN kinds s ON m.pdf = s.pdf AND m.page = s.page AND m.kind = 'MC'
  AND abs(s.x - m.x) <= greatest(220, 10 * m.w) AND abs(s.y - m.y) <= greatest(180, 10 * m.h)),
pairs AS (SELECT a.pdf, a.page, a.seq, b.seq AS other_seq, upper(a.text || ' ' || b.text) AS text, a.x, least(a.y, b.y) AS y, b.x + b.w - a.x AS w, greatest(a.y + a.h, b.y + b.h) - least(a.y, b.y) AS h
  FROM near a JOIN near b ON a.pdf = b.pdf AND a.page = b.page AND a.motor_seq = b.motor_seq AND (a.x < b.x OR (a.x = b.x AND a.seq < b.seq))
  AND abs(a.y - b.y) <= greatest(30, 1.5 * least(a.h, b.h)) AND b.x - a.x - a.w <= 180 AND regexp_matches(upper(a.text || ' ' || b.text), '{_UNIT}')),
named AS (SELECT DISTINCT *, CAST(CAST(regexp_extract(text, '{_UNIT}', 1) AS INT) AS VARCHAR) || CASE WHEN left(regexp_extract(text, '{_UNIT}', 2), 1) = 'P' THEN ' pair' ELSE ' core' END AS cable FROM pairs),
once AS (SELECT *, row_number() OVER (PARTITION BY pdf, page, cable, x, y, w, h ORDER BY seq, other_seq) AS r FROM named)
SELECT pdf, page, seq, other_seq, cable, text, x, y, w, h FROM once WHERE r = 1""")
def j12_split_cables(spark, sf):
    return spatial.split_cables(_by_area(spark, sf), BY_AREA).drop("confidence")


@query()
def j21_o06_best_motors(spark, sf):
    # Pages with several motor cables: the lines of ten orders make up one.
    return spatial.best_motors(_by_area(spark, sf).withColumn("page", F.floor(F.col("page") / 10)), BY_AREA)


# Spans of two tags and a note, and their words: the second tag's number may be a word of its own, and one word in seven lies outside.
_LINES = "(SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber) AS BIGINT) AS line FROM lineitem) AS lines"


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    """The numbered lines, written once: the views over them have a part for each word or fragment."""
    return stored(A.view(spark, sf, f"SELECT l_orderkey, l_partkey, l_suppkey, line FROM {_LINES}"))


def _of_lines(lines: DataFrame, sql: str) -> DataFrame:
    return lines.sparkSession.sql(sql.replace(_LINES, "{lines} AS lines"), lines=lines)


_TWO = "'TE-', CAST(100 + l_partkey % 900 AS STRING), ' FT-', CAST(100 + l_suppkey % 900 AS STRING)"
_AT = "concat('pdf_', CAST(l_orderkey % 10 AS STRING)) AS pdf, l_orderkey AS page"
TWO_TAGS = f"SELECT {_AT}, line AS seq, 100 AS x, CAST(200 * line AS INT) AS y, 300 AS w, 14 AS h, CAST(0.9 AS DOUBLE) AS confidence, concat({_TWO}, ' NOTE') AS text FROM {_LINES}"
_WORD = "SELECT {at}, line * 10 + {k} AS seq, {x} AS x, CAST(200 * line + 1 AS INT) AS y, {w} AS w, 12 AS h, CAST(0.8 AS DOUBLE) AS confidence, {text} AS text FROM {lines}"
TWO_TAGS_WORDS = " UNION ALL ".join([
    _WORD.format(at=_AT, lines=_LINES, k=1, x="CASE WHEN l_partkey % 7 = 0 THEN 90 ELSE 99 END", w=60, text="concat('TE-', CAST(100 + l_partkey % 900 AS STRING))"),
    _WORD.format(at=_AT, lines=_LINES, k=2, x=170, w=30, text="CASE WHEN l_partkey % 2 = 0 THEN 'FT-' ELSE concat('FT-', CAST(100 + l_suppkey % 900 AS STRING)) END"),
    _WORD.format(at=_AT, lines=_LINES, k=3, x=210, w=40, text="CASE WHEN l_partkey % 2 = 0 THEN CAST(100 + l_suppkey % 900 AS STRING) ELSE 'SEE' END"),
    _WORD.format(at=_AT, lines=_LINES, k=4, x=300, w=102, text="'NOTE'"),
])


@query(f"""WITH s AS ({TWO_TAGS}), w AS ({TWO_TAGS_WORDS}) SELECT s.pdf, s.page, s.seq, w.seq AS word_seq, w.text FROM s JOIN w ON s.pdf = w.pdf AND s.page = w.page
  AND w.x >= s.x - 2 AND w.y >= s.y - 2 AND w.x + w.w <= s.x + s.w + 2 AND w.y + w.h <= s.y + s.h + 2""")
def j13_s15_words_inside(spark, sf):
    lines = _lines(spark, sf)
    return spatial.words_inside(_of_lines(lines, TWO_TAGS), _of_lines(lines, TWO_TAGS_WORDS)).select("pdf", "page", "seq", "word_seq", "text")


@query(f"""WITH s AS ({TWO_TAGS}), t AS (SELECT *, split_part(text, ' ', 1) AS one, split_part(text, ' ', 2) AS two FROM s),
l AS (SELECT {_AT}, line AS seq, l_partkey % 7 = 0 AS outside, l_partkey % 2 = 0 AS apart FROM {_LINES}), j AS (SELECT t.*, outside, apart FROM t JOIN l USING (pdf, page, seq))
SELECT pdf, page, seq, 0 AS part, text, x, w FROM j WHERE outside
UNION ALL SELECT pdf, page, seq, 0, one, 99, 60 FROM j WHERE NOT outside
UNION ALL SELECT pdf, page, seq, 1, two, 170, CASE WHEN apart THEN 80 ELSE 30 END FROM j WHERE NOT outside
UNION ALL SELECT pdf, page, seq, 2, 'SEE', 210, 40 FROM j WHERE NOT outside AND NOT apart
UNION ALL SELECT pdf, page, seq, CASE WHEN apart THEN 2 ELSE 3 END, 'NOTE', 300, 102 FROM j WHERE NOT outside""")
def t11_split_spans(spark, sf):
    found = F.regexp_extract_all(F.col("text"), F.lit("[A-Z]{2}-[0-9]+"), F.lit(0))
    lines = _lines(spark, sf)
    spans = _of_lines(lines, TWO_TAGS).withColumns({"candidates": found, "alone": F.lit(False)})
    return spatial.split_spans(spans, _of_lines(lines, TWO_TAGS_WORDS)).select("pdf", "page", "seq", "part", "text", "x", "w")


# Tags in two or three fragments, one in three with its number too far away.
_PIECE = "SELECT {at}, line * 10 + {k} AS seq, CAST({x} AS INT) AS x, CAST(40 * line AS INT) AS y, {w} AS w, 12 AS h, CAST(0.9 AS DOUBLE) AS confidence, {text} AS text FROM {lines}{where}"
FRAGMENTS = " UNION ALL ".join([
    _PIECE.format(at=_AT, lines=_LINES, k=1, x=100, w=20, text="'TE'", where=""),
    _PIECE.format(at=_AT, lines=_LINES, k=2, x=122, w=6, text="'-'", where=" WHERE l_partkey % 2 = 0"),
    _PIECE.format(at=_AT, lines=_LINES, k=3, x="CASE WHEN l_partkey % 2 = 0 THEN 130 ELSE 125 END + CASE WHEN l_partkey % 3 = 0 THEN 40 ELSE 0 END", w=40, text="CAST(l_partkey AS STRING)", where=""),
    _PIECE.format(at=_AT, lines=_LINES, k=4, x=185, w=70, text="'PT-100'", where=" WHERE l_partkey % 3 > 0"),
])


@query(f"""WITH f AS ({FRAGMENTS}), l AS (SELECT {_AT}, line, l_partkey AS n FROM {_LINES}),
j AS (SELECT f.*, n, n % 3 > 0 AND seq % 10 < 4 AS joined FROM f JOIN l ON f.pdf = l.pdf AND f.page = l.page AND f.seq // 10 = line)
SELECT pdf, page, seq, seq AS last_seq, text, x, w FROM j WHERE NOT joined
UNION ALL SELECT pdf, page, seq, seq + 2, CASE WHEN n % 2 = 0 THEN 'TE - ' ELSE 'TE ' END || CAST(n AS VARCHAR), 100, CASE WHEN n % 2 = 0 THEN 70 ELSE 65 END FROM j WHERE joined AND seq % 10 = 1""")
def j09_joined_fragments(spark, sf):
    spans = _of_lines(_lines(spark, sf), FRAGMENTS).withColumn("known", F.col("text").rlike(drawing.TAG))
    return spatial.joined_fragments(spans, _refs(spark, sf)).select("pdf", "page", "seq", "last_seq", "text", "x", "w")


# Recovery ---------------------------------------------------------------------------------------------------------------------------
# Tokens near and far from what the references begin with; references with attached and dashed area numbers as well.
NEAR_TAGS = """
SELECT DISTINCT concat('see ', CASE l_partkey % 11 WHEN 0 THEN 'TE-' WHEN 1 THEN 'TEE-' WHEN 2 THEN 'T-' WHEN 3 THEN 'ZQ-' WHEN 4 THEN 'PT' WHEN 5 THEN '12PT-' WHEN 6 THEN '7-LIT-' WHEN 7 THEN 'LIT-' WHEN 8 THEN '12XX' WHEN 9 THEN 'ABCDEFG' ELSE 'TE_' END,
  CAST(l_suppkey % 97 + CASE WHEN l_linenumber > 3 THEN 1000 ELSE 1 END AS STRING), CASE l_linenumber WHEN 1 THEN '-A' WHEN 2 THEN 'BC' ELSE '' END, ' end') AS text FROM lineitem
"""
NEAR_REFERENCE = """
SELECT p_partkey AS ref_seq, CASE p_partkey % 4 WHEN 0 THEN concat('TE-', CAST(p_partkey AS STRING)) WHEN 1 THEN concat('12PT-', CAST(p_partkey AS STRING)) WHEN 2 THEN concat('7-LIT-', CAST(p_partkey AS STRING)) ELSE concat('PDT_', CAST(p_partkey AS STRING), 'A') END AS reference FROM part
"""
SQL_NEAR = f"""
n AS (SELECT DISTINCT replace(upper(trim(reference)), '_', '-') AS t FROM ({NEAR_REFERENCE}) x), f AS (SELECT min(length(t)) AS shortest, max(length(t)) AS longest, avg(CASE WHEN t LIKE '%-%' THEN 1.0 ELSE 0.0 END) AS hyphens FROM n),
d AS (SELECT avg(length(run)) AS mean_run FROM (SELECT unnest(regexp_extract_all(t, '[0-9]+')) AS run FROM n) x),
w AS (SELECT DISTINCT replace(split_part(text, ' ', 2), '_', '-') AS tag, text FROM ({NEAR_TAGS}) x),
p AS (SELECT *, CASE WHEN regexp_matches(tag, '^[0-9]{{1,4}}-[A-Z]{{1,6}}[-0-9]') THEN split_part(tag, '-', 2) ELSE regexp_extract(tag, '^[A-Z0-9]+') END AS prefix,
  regexp_full_match(tag, '{"|".join(recovery.SHAPES)}') AS shaped FROM w),
s AS (SELECT text, tag, CASE WHEN NOT shaped OR length(tag) < 4 THEN 0.0 ELSE least(1.0, 0.35 + CASE WHEN prefix IN ('TE', 'PT', 'LIT', 'PDT') THEN 0.35 WHEN levenshtein(prefix, 'TE') <= 1 OR levenshtein(prefix, 'PT') <= 1 OR levenshtein(prefix, 'LIT') <= 1 OR levenshtein(prefix, 'PDT') <= 1 THEN 0.22 ELSE 0.0 END
  + CASE WHEN length(tag) BETWEEN shortest - 2 AND longest + 2 THEN 0.15 ELSE 0.0 END + 0.1 * greatest(0.0, 1 - abs(length(regexp_extract(tag, '[0-9]+')) - mean_run) / greatest(mean_run, 1.0))
  + CASE WHEN (hyphens >= 0.5) = (tag LIKE '%-%') THEN 0.1 ELSE 0.0 END) END AS score FROM p, f, d)"""


@query(f"WITH {SQL_NEAR} SELECT DISTINCT tag, round(CAST(score AS DOUBLE), 9) AS score FROM s")
def h18_profile_scores(spark, sf):
    tags = A.view(spark, sf, NEAR_TAGS).select(X.canonical_tag(F.split("text", " ")[1]).alias("tag")).distinct()
    return recovery.scored(tags, match.references(A.view(spark, sf, NEAR_REFERENCE))).select("tag", F.round("score", 9).alias("score"))


@query(f"""WITH {SQL_NEAR} SELECT text, tag, round(CAST(score AS DOUBLE), 9) AS score FROM s WHERE length(tag) >= 4 AND (score >= 0.62
  OR (regexp_full_match(tag, '[A-Z0-9]{{2,6}}-?[A-Z0-9]{{1,10}}(-[A-Z0-9]{{1,10}}){{0,3}}') AND regexp_matches(tag, '^(TE|PDT|12PT)[-0-9]|^[0-9]{{1,4}}-LIT[-0-9]')))""")
def h19_h21_profile_candidates(spark, sf):
    found = recovery.candidates(A.view(spark, sf, NEAR_TAGS), match.references(A.view(spark, sf, NEAR_REFERENCE)))
    return found.select("text", "tag", F.round("score", 9).alias("score"))


# Readings of references with one, two or three characters taken for others, in both directions.
MISREAD = """
SELECT concat('TEO-', CAST(p_partkey AS STRING), 'B') AS reference, p_partkey AS ref_seq,
  CASE p_partkey % 5 WHEN 0 THEN concat('TEO-', CAST(p_partkey AS STRING), '8') WHEN 1 THEN concat('TE0-', CAST(p_partkey AS STRING), '8') WHEN 2 THEN concat('teo-', translate(CAST(p_partkey AS STRING), '01', 'OI'), 'b')
    WHEN 3 THEN concat('TED-', translate(CAST(p_partkey AS STRING), '5', 'S'), 'B') ELSE concat('TEO-', CAST(p_partkey AS STRING), 'B') END AS tag FROM part
"""


@query(f"""WITH m AS ({MISREAD}), r AS (SELECT DISTINCT upper(reference) AS reference FROM m), t AS (SELECT DISTINCT tag, upper(tag) AS u FROM m),
p AS (SELECT tag, u, reference, [i for i in range(1, length(u) + 1) if u[i:i] <> reference[i:i]] AS places FROM t JOIN r ON translate(u, 'ODQUISBZG', '000015826') = translate(reference, 'ODQUISBZG', '000015826')),
ok AS (SELECT *, len([i for i in places if regexp_matches(u[i:i], '[0-9]') = regexp_matches(reference[i:i], '[0-9]')]) = 0 AND len(places) <= 2 AS good FROM p),
best AS (SELECT tag, arg_min(reference, [len(places)] || places) AS reference FROM ok WHERE good GROUP BY tag)
SELECT t.tag, coalesce(best.reference, u) AS corrected FROM t LEFT JOIN best ON t.tag = best.tag""")
def x20_corrected(spark, sf):
    m = A.view(spark, sf, MISREAD)
    return recovery.corrected(m.select("tag"), match.references(m.select("reference", "ref_seq")))


# Fonts: of three on a page, one comes out 29 codes too low, one is sound, one is too short to tell.
_SHIFTED = "".join(chr(ord(c) - 29) for c in "TEFV-0123456789")
FONT_SPANS = f"""
SELECT l_orderkey % 50 AS page, concat('pdf_', CAST(l_orderkey % 10 AS STRING)) AS pdf, l_partkey * 100000 + l_suppkey % 10000 * 10 + l_linenumber AS seq,
  CASE WHEN l_linenumber <= 3 THEN 'A' WHEN l_linenumber <= 6 THEN 'B' ELSE concat('C', CAST(l_partkey AS STRING)) END AS font,
  concat(CASE WHEN l_partkey % 2 = 0 THEN 'TE-' ELSE 'FV-' END, CAST(l_partkey AS STRING), ' ') AS plain,
  CASE WHEN l_linenumber <= 3 OR l_linenumber > 6 THEN translate(concat(CASE WHEN l_partkey % 2 = 0 THEN 'TE-' ELSE 'FV-' END, CAST(l_partkey AS STRING)), 'TEFV-0123456789', '{_SHIFTED}') ELSE concat(' FV-', CAST(l_partkey AS STRING), ' ') END AS text
FROM lineitem
"""


@query(f"""WITH s AS ({FONT_SPANS}), f AS (SELECT pdf, page, font, sum(length(text)) AS chars, sum(length(regexp_replace(text, '[^\\x00-\\x1f]', '', 'g'))) AS controls FROM s GROUP BY pdf, page, font)
SELECT pdf, page, font, CAST(chars AS BIGINT) AS chars, CAST(controls AS BIGINT) AS controls, chars >= 20 AND controls >= 3 AND controls >= 0.1 * chars AND font <> 'B' AS shifted FROM f""")
def a27_font_statistics(spark, sf):
    return fonts.font_statistics(A.view(spark, sf, FONT_SPANS)).drop("printable")


@query(f"""WITH s AS ({FONT_SPANS}), f AS (SELECT pdf, page, font, sum(length(text)) AS chars FROM s GROUP BY pdf, page, font)
SELECT s.pdf, s.page, s.seq, CASE WHEN s.font = 'B' OR (s.font <> 'A' AND chars >= 20) OR s.font = 'A' THEN trim(CASE WHEN s.font = 'B' THEN text ELSE plain END) END AS text
FROM s JOIN f ON s.pdf = f.pdf AND s.page = f.page AND s.font = f.font WHERE s.font = 'B' OR chars >= 20""")
def s13_repaired_fonts(spark, sf):
    long = F.sum(F.length("text")).over(Window.partitionBy("pdf", "page", "font")) >= 20
    spans = A.view(spark, sf, FONT_SPANS).withColumn("long", long).filter(F.col("long") | (F.col("font") == "B"))
    return fonts.repaired(spans.select("pdf", "page", "seq", "font", "text")).select("pdf", "page", "seq", "text")


# Words near tags, run statistics, rows kept as JSON ---------------------------------------------------------------------------------
# Words of a text layer: tags as they are, with a character more, less or another, and others far from any.
WORDS = """
SELECT l_orderkey AS page, l_partkey * 100000 + l_suppkey % 10000 * 10 + l_linenumber AS word_no,
  CASE l_linenumber WHEN 1 THEN concat('TE-', CAST(l_partkey AS STRING)) WHEN 2 THEN concat('TE-', CAST(l_partkey AS STRING), 'X') WHEN 3 THEN concat('TEE-', CAST(l_partkey AS STRING), '-A') WHEN 4 THEN concat('T-', CAST(l_partkey AS STRING), '-A')
    WHEN 5 THEN concat('XX-', CAST(l_partkey AS STRING)) ELSE concat('NOTE ', CAST(l_suppkey AS STRING)) END AS text FROM lineitem
"""
WORD_TAGS = "SELECT concat('TE-', CAST(p_partkey AS STRING), '-A') AS tag FROM part"


@query()
def j16_h23_fuzzy_words(spark, sf):
    words, tags = A.view(spark, sf, WORDS), A.view(spark, sf, WORD_TAGS)
    earlier = stored(textmode.single(words, tags).filter("tag is not null").select("page", "text", "tag"))  # read in two branches
    return textmode.fuzzy(words, tags, earlier)


def _exact_or_not(spark: SparkSession, sf: str) -> DataFrame:
    found = match.exact(_tags(spark, sf), match.references(A.view(spark, sf, SHIFTED_REFERENCE)))
    return found.select("tag", F.when(F.col("reference").isNotNull(), "exact").otherwise("unmatched").alias("match_type"))


_SHIFTED_EXACT = f"{SQL_KIND}, {SQL_EXACT.replace(A.IO_REFERENCE, SHIFTED_REFERENCE)}"


@query(f"""WITH {_SHIFTED_EXACT} SELECT count(*) AS match_attempts, count(reference) AS exact_matches, 0 AS similar_matches, count(*) - count(reference) AS unmatched, count(reference) / CAST(count(*) AS DOUBLE) AS exact_rate, CAST(0 AS DOUBLE) AS similar_rate,
  (SELECT count(*) FROM r) AS reference_tag_count FROM exact""")
def a15_match_statistics(spark, sf):
    return match.statistics(_exact_or_not(spark, sf), match.references(A.view(spark, sf, SHIFTED_REFERENCE)))


@query(f"WITH {_SHIFTED_EXACT} SELECT CASE WHEN reference IS NULL THEN 'unmatched' ELSE 'exact' END AS match_type, count(*) AS n FROM exact GROUP BY 1")
def a16_match_types(spark, sf):
    return match.by_type(_exact_or_not(spark, sf))


JSON_ROWS = """
SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN concat('{"Tag": "', CAST(o_orderkey AS STRING), '", "JB": "', o_orderstatus, '"}') WHEN 1 THEN concat('{"Tag": "T", "Note ', CAST(o_custkey % 7 AS STRING), '": "', o_orderpriority, '"}')
  WHEN 2 THEN '{}' WHEN 3 THEN 'not an object' ELSE concat('{"Channel": ', CAST(o_custkey AS STRING), '}') END AS raw_json FROM orders
"""


@query(f"""WITH j AS ({JSON_ROWS}), k AS (SELECT DISTINCT name FROM (SELECT unnest(json_keys(raw_json)) AS name FROM j WHERE raw_json LIKE '{{%') x UNION SELECT unnest(['JB', 'Tag', 'Cable']))
SELECT CAST(row_number() OVER (ORDER BY CASE name WHEN 'JB' THEN 0 WHEN 'Tag' THEN 1 WHEN 'Cable' THEN 2 ELSE 3 END, name) - 1 AS INT) AS place, name FROM k""")
def c06_json_columns(spark, sf):
    return store.json_columns(A.view(spark, sf, JSON_ROWS), ["JB", "Tag", "Cable"])


@query(f"""WITH j AS ({JSON_ROWS}) SELECT id, CASE id % 5 WHEN 0 THEN json_extract_string(raw_json, '$.Tag') WHEN 1 THEN 'T' ELSE '' END AS "Tag", CASE WHEN id % 5 = 4 THEN json_extract_string(raw_json, '$.Channel') ELSE '' END AS "Channel" FROM j""")
def c05_json_values(spark, sf):
    return store.json_values(A.view(spark, sf, JSON_ROWS), ["Tag", "Channel"]).select("id", "Tag", "Channel")


JSON_SIZES = """
SELECT p_partkey AS id, concat('{"Type ', CAST(p_partkey % 3 AS STRING), '": {"FRONT": {"length": ', CAST(p_size AS STRING), ', "rails": 2}', CASE WHEN p_size % 2 = 0 THEN ', "REAR": {"length": 7, "rails": 5}' ELSE '' END, '}, "Other": {}}') AS raw_json FROM part
"""


@query("""SELECT p_partkey AS id, concat('Type ', CAST(p_partkey % 3 AS STRING)) AS "outer", 'FRONT' AS middle, CAST(p_size AS DOUBLE) AS length, 2 AS rails FROM part
UNION ALL SELECT p_partkey, concat('Type ', CAST(p_partkey % 3 AS STRING)), 'REAR', 7, 5 FROM part WHERE p_size % 2 = 0""")
def c09_nested_sizes(spark, sf):
    return store.nested(A.view(spark, sf, JSON_SIZES), "struct<length:double,rails:int>")


# Counts beside labels (the number after a label is its own by the default pattern, and no count), cables' pairs against tags' numbers ----------------------------------------------------------------------------
_LABEL = "SELECT 'a' AS pdf, l_orderkey * 10000000000 + l_partkey * 100000 + l_suppkey % 10000 * 10 + l_linenumber AS page, {of}, 12 AS h, CAST(0.9 AS DOUBLE) AS confidence, CAST(l_partkey AS BIGINT) AS n, CAST(l_suppkey AS BIGINT) AS m FROM lineitem"
LABELS = " UNION ALL ".join([
    _LABEL.format(of="1 AS seq, 100 AS x, 60 AS y, 40 AS w, CASE l_partkey % 4 WHEN 1 THEN '2 SPARE' WHEN 2 THEN 'SPARE 3' ELSE 'SPARE' END AS text"),
    _LABEL.format(of="2 AS seq, CAST(CASE WHEN l_partkey % 3 = 0 THEN 90 - l_partkey % 31 ELSE 130 + l_partkey % 37 END AS INT) AS x, CAST(52 + l_suppkey % 17 AS INT) AS y, 10 AS w, CAST(1 + l_partkey % 9 AS STRING) AS text"),
])


@query(f"""WITH v AS ({LABELS}), b AS (SELECT page, n, y, CASE WHEN x < 100 THEN 100 - x - 10 ELSE x - 140 END AS gap FROM v WHERE seq = 2)
SELECT 'a' AS pdf, page, 1 AS seq, CAST(CASE n % 4 WHEN 1 THEN 2 ELSE CASE WHEN abs(y - 60) <= 6 AND gap BETWEEN 0 AND 18 THEN 1 + n % 9 ELSE 1 END END AS INT) AS spares FROM b""")
def j10_x24_counts_beside_labels(spark, sf):
    return drawing.spare_counts(stored(drawing.classified(A.view(spark, sf, LABELS))))  # read in four branches


@query(f"""WITH {SQL_BY_AREA}, s AS (SELECT * FROM kinds), {SQL_NUMBERED}, h AS (SELECT pdf, page, CAST(max(number) AS INT) AS highest FROM numbered WHERE kind = 'Tag' GROUP BY pdf, page),
p AS (SELECT pdf, page, max(CAST(split_part(token, ' ', 1) AS INT)) AS pair FROM kinds WHERE kind = 'Cable' GROUP BY pdf, page), e AS (SELECT DISTINCT pdf, page FROM kinds)
SELECT e.pdf, e.page, coalesce(pair, -1) AS pair, coalesce(highest, -1) AS highest, CASE WHEN pair IS NULL THEN 'WARNING: Could not extract pair number from cable description' WHEN highest IS NULL THEN 'WARNING: No tag numbers found' WHEN pair = highest THEN 'OK'
  ELSE format('WARNING: Pair number ({{}}) != Max Tag number ({{}})', pair, highest) END AS status FROM e LEFT JOIN h ON e.pdf = h.pdf AND e.page = h.page LEFT JOIN p ON e.pdf = p.pdf AND e.page = p.page""")
def a22_a30_pairs_on_sheets(spark, sf):
    return drawing.pair_consistency(_by_area(spark, sf)).na.fill(-1, ["pair", "highest"])


# Pages of which some are broken -------------------------------------------------------------------------------------------------------
PAGES_AS_TEXT = """
SELECT concat('pdf_', CAST(o_custkey % 40 AS STRING)) AS pdf, o_orderkey AS page, CASE WHEN o_orderkey % 11 = 0 THEN '[["TE' WHEN o_orderkey % 13 = 0 THEN '[["TE-1", "far"]]' WHEN o_orderkey % 17 = 0 THEN NULL
  WHEN o_orderkey % 5 = 0 THEN '[]' ELSE concat('[["TE-', CAST(o_custkey AS STRING), '", ', CAST(o_orderkey % 100 AS STRING), '], ["JB-1", 7]]') END AS content FROM orders
"""
_SPAN = StructType([StructField("text", StringType()), StructField("x", IntegerType())])


def _read_page(content: str) -> list[list]:
    return json.loads(content)


def _pages_read(spark: SparkSession, sf: str) -> DataFrame:
    return guarded.processed(A.view(spark, sf, PAGES_AS_TEXT), ["pdf", "page"], "content", _read_page, _SPAN)


@query(f"""WITH p AS ({PAGES_AS_TEXT}), f AS (SELECT *, page % 11 = 0 OR page % 13 = 0 OR content IS NULL AS failed FROM p)
SELECT pdf, count(*) AS items, count(*) FILTER (failed) AS failed, CAST(sum(CASE WHEN failed OR page % 5 = 0 THEN 0 ELSE 2 END) AS BIGINT) AS found FROM f GROUP BY pdf""")
def t16_a29_failed_pages(spark, sf):
    return guarded.run_statistics(_pages_read(spark, sf), ["pdf"]).drop("first_error")


@query("""WITH p AS (SELECT concat('pdf_', CAST(o_custkey % 40 AS VARCHAR)) AS pdf, o_orderkey AS page, o_custkey FROM orders WHERE o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0 AND o_orderkey % 17 <> 0 AND o_orderkey % 5 <> 0)
SELECT pdf, page, concat('TE-', CAST(o_custkey AS VARCHAR)) AS text, CAST(page % 100 AS INT) AS x FROM p UNION ALL SELECT pdf, page, 'JB-1', 7 FROM p""")
def s35_rows_of_good_pages(spark, sf):
    return guarded.rows_of(_pages_read(spark, sf))
