"""Views that give the star-schema tables the shapes of instrument data. Each SQL text runs in Spark and in other ANSI engines alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

IO_SIGNALS = """
SELECT l_orderkey * 100000000000 + l_partkey * 100000 + (l_suppkey % 1000) * 100 + (l_linenumber % 10) * 10 + CAST(l_quantity AS BIGINT) % 10 AS seq,
  concat(CASE l_partkey % 5 WHEN 0 THEN 'TE' WHEN 1 THEN 'PT' WHEN 2 THEN 'FV' WHEN 3 THEN 'LT' ELSE 'XV' END, '-', CAST(l_partkey AS STRING)) AS tag,
  CASE WHEN l_partkey % 41 = 0 THEN '-' WHEN l_partkey % 43 = 0 THEN '' ELSE concat('JB-', CAST(l_orderkey AS STRING)) END AS jb,
  CASE WHEN l_partkey % 47 = 0 THEN 'AI-R' ELSE CASE concat(l_returnflag, l_linestatus)
    WHEN 'AO' THEN 'AI' WHEN 'AF' THEN 'A.O' WHEN 'NO' THEN 'di' WHEN 'NF' THEN 'D O' WHEN 'RO' THEN 'DI-R' ELSE 'DOR' END END AS io_type,
  CASE WHEN l_orderkey % 53 = 0 THEN 'EX' WHEN o_orderpriority = '1-URGENT' THEN 'IS' WHEN o_orderpriority = '2-HIGH' THEN 'I.S'
    WHEN o_orderpriority LIKE '4%' THEN 'N.I.S' ELSE 'NIS' END AS safety,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'FIELD' WHEN 'MACHINERY' THEN 'MCC ROOM' WHEN 'AUTOMOBILE' THEN 'LOCAL' WHEN 'FURNITURE' THEN 'UCP' ELSE 'YARD' END AS location,
  concat('T', lpad(CAST(2 * l_linenumber - 1 AS STRING), 2, '0')) AS terminal_1,
  concat('T', lpad(CAST(2 * l_linenumber AS STRING), 2, '0')) AS terminal_2,
  CASE WHEN l_quantity > 40 THEN 'SC' ELSE '' END AS src,
  l_orderkey AS jb_key, o_custkey AS run_id
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
"""
IO_REFERENCE = """
SELECT p_partkey AS ref_seq, concat('TE', CASE WHEN p_partkey % 11 = 0 THEN ' ' WHEN p_partkey % 7 = 0 THEN '_' ELSE '-' END, CAST(p_partkey AS STRING)) AS reference FROM part
"""
SPANS = """
SELECT concat('pdf_', CAST(l_orderkey % 10 AS STRING)) AS pdf, l_orderkey AS page,
  CAST(l_partkey % 800 AS INT) AS x, CAST(40 * l_linenumber AS INT) AS y, 100 AS w, 20 AS h, (l_partkey % 100) / CAST(100.0 AS DOUBLE) AS confidence,
  l_partkey * 10000 + (l_suppkey % 1000) * 10 + l_linenumber % 10 AS seq,
  CASE l_suppkey % 10 WHEN 0 THEN concat('JB-', CAST(l_orderkey % 500 AS STRING)) WHEN 1 THEN concat('MC-', CAST(l_orderkey % 500 AS STRING)) WHEN 2 THEN 'SPARE'
    WHEN 3 THEN concat('NC-', CAST(l_partkey % 7 AS STRING), '-', CAST(l_linenumber AS STRING), '-C') WHEN 4 THEN '02-JUL-2025'
    ELSE concat('TE', CASE WHEN l_partkey % 3 = 0 THEN '_' ELSE '-' END, CAST(l_partkey AS STRING)) END AS text
FROM lineitem
"""
IO_ROWS = """
SELECT o_custkey AS run_id, o_orderkey AS id, concat('JB-', CAST(o_custkey % 7 AS STRING)) AS jb, o_orderpriority AS status, o_totalprice AS price,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS row_index FROM orders
"""
RUN_LOG = "SELECT event_id AS id, user_id AS run_id, ts AS created, event_type AS level, value FROM events"
WORKBOOK_A = "SELECT concat('TE-', CAST(p_partkey AS STRING)) AS tag, p_brand AS io_type, CASE WHEN p_size > 25 THEN p_type END AS safety FROM part WHERE p_size > 15"
WORKBOOK_B = "SELECT concat('TE-', CAST(p_partkey AS STRING)) AS tag, concat('JB-', CAST(p_size AS STRING)) AS jb, CASE WHEN p_size > 10 THEN p_type END AS safety FROM part WHERE p_size <= 35"
WORKBOOK_C = "SELECT concat('TE-', CAST(p_partkey AS STRING)) AS tag, p_name AS cable, CASE WHEN p_size > 40 THEN 'JB-9' END AS jb FROM part WHERE p_retailprice > 1200"

TABLES = ("lineitem", "orders", "customer", "part", "events", "supplier", "documents", "nation", "region")


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The view over the Parquet tables of a folder; only those that the text names are opened."""
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f" {t}" in sql}
    sql = sql.replace("{", "{{").replace("}", "}}")  # braces of the text itself
    for t in frames:
        sql = sql.replace(f" {t}", f" {{{t}}}")
    return spark.sql(sql, **frames)
