"""What only larger tables show: long numbers, ids that repeat, groups as large as the table, lists too large for the driver."""

import random
import shutil
from contextlib import redirect_stdout
from io import StringIO

import duckdb
import pyarrow.compute as pc
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tagwright.operators import assign, clean, drawing, match, store
from tagwright.plans import handed_out, more, queries, sheets  # noqa: F401
from tagwright.sources.tables import placed


def plan(df) -> str:
    with redirect_stdout(StringIO()) as out:
        df.explain("extended")
    return out.getvalue()


def test_tags_with_long_numbers(spark):
    texts = ["TE-999999", "TE-1000003", "TE_1000017", "TE-123456789", "see TE-1000003", "NC-1-2-C", "02-JUL-2025"]
    got = drawing.classified(spark.createDataFrame([(t,) for t in texts], "text string")).collect()
    assert [r["kind"] for r in got] == ["Tag", "Tag", "Tag", "Tag", "Unknown", "Cable", "Unknown"]


@pytest.fixture(scope="module")
def long_numbers(tmp_path_factory):
    """The smallest tables with parts numbered from 1,000,000 on."""
    folder = tmp_path_factory.mktemp("long")
    for name in ("lineitem", "part"):
        t = pq.read_table(f"/root/testdata/sf0.001/{name}.parquet")
        at = t.schema.names.index(f"{name[0]}_partkey")
        pq.write_table(t.set_column(at, t.schema.names[at], pc.add(t.column(at), 1_000_000)), folder / f"{name}.parquet")
    for name in ("orders", "customer"):
        shutil.copy(f"/root/testdata/sf0.001/{name}.parquet", folder)
    return str(folder)


@pytest.mark.parametrize("name", ["a08_duplicates_across", "a14_a18_match_rate", "a15_match_statistics", "a16_match_types", "a17_pdf_stats", "a23_number_consistency", "a26_page_metrics",
                                  "f27_review_candidates", "j05_separator_exact", "j07_u02_unmatched", "j08_u03_missing_references"])
def test_queries_on_long_numbers_equal_their_sql(spark, long_numbers, name):
    got = queries.QUERIES[name](spark, long_numbers)
    db = duckdb.connect()
    for table in ("lineitem", "part", "orders", "customer"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{long_numbers}/{table}.parquet'")
    want = db.execute(f"SELECT {', '.join(f'"{c}"' for c in got.columns)} FROM ({queries.ORACLES[name]}) x").fetchall()
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_kinds_as_by_the_patterns_alone(spark):
    draw = random.Random(7)
    parts = ["JB", "MC", "SPARE", "NC", "CAB", "TE", "IP65", "BK", "-", "_", ".", " ", "1", "12", "1234", "mm2", "pair", "Px", "A", "jul", "2025", "PAGE", "²"]
    words = spark.createDataFrame([("".join(draw.choices(parts, k=draw.randint(1, 7))),) for _ in range(4000)], "text string")
    u = F.upper(F.trim("text"))
    tag = ((F.regexp_extract(u, drawing.TAG, 1) != "") | u.rlike("^[A-Z]{2,5}[-_][0-9]+$")) & ~drawing.non_tag(F.col("text"))
    plain = F.when(u.rlike("^" + drawing.MC) & u.rlike(drawing.JB), "MC").when(u.rlike(drawing.JB), "JB").when(u.rlike(drawing.MC), "MC").when(u.rlike(drawing.SPARE), "SPARE").when(tag, "Tag").when(u.rlike(drawing.CABLE), "Cable").otherwise("Unknown")
    got = words.select("text", drawing.kind(F.col("text")).alias("kind"), plain.alias("plain"))
    assert got.filter("kind <> plain").collect() == [] and got.select("kind").distinct().count() == 6


def test_an_issue_stays_one_row(spark):
    issues = spark.createDataFrame([(1, "OPEN"), (1, "OPEN"), (2, "OPEN")], "id long, status string").withColumns({"created_at": F.lit(5), "resolved_at": F.lit(None).cast("int")})
    changes = spark.createDataFrame([(1, "RESOLVED"), (1, "RESOLVED"), (1, "IGNORED")], "id long, new_status string")
    assert sorted(tuple(r) for r in store.patched(issues, changes).select("id", "status", "resolved_at").collect()) == [(1, "RESOLVED", 5), (1, "RESOLVED", 5), (2, "OPEN", None)]


def test_thinned_in_one_stream(spark):
    draw = random.Random(3)
    rows = [("a", k % 3, draw.randrange(200), draw.randrange(900), k, "SPARE") for k in range(600)]
    out = drawing.thinned(spark.createDataFrame(rows, "pdf string, page long, x int, y int, seq long, kind string"))
    for page in range(3):
        own = sorted((r for r in rows if r[1] == page), key=lambda r: (r[3], r[2], r[4]))
        kept = [r[4] for r, stays in zip(own, drawing.thin([(r[2], r[3]) for r in own]), strict=True) if stays]
        assert sorted(kept) == sorted(r["seq"] for r in out.filter(F.col("page") == page).collect())
    assert "FlatMapGroups" not in plan(out)  # no call for each page


def test_places_in_groups_as_large_as_the_table(spark):
    df = spark.range(5000).select((F.col("id") % 2).alias("g"), F.when(F.col("id") % 7 > 0, F.col("id") * 37 % 101).alias("a"), F.col("id").alias("b")).withColumn("g", F.when(F.col("b") % 10 > 0, F.col("g")))
    out = placed(df, ["g"], [F.desc("a"), "b"], "place")
    want = df.withColumn("place", F.row_number().over(Window.partitionBy("g").orderBy(F.desc("a"), "b")))
    assert out.exceptAll(want.withColumn("place", F.col("place").cast("long"))).count() == 0 and out.count() == 5000
    signals = spark.createDataFrame([("AI", "IS", f"JB-{k}", 1) for k in range(10)], "io string, safety string, jb string, rank_location int")
    assert "__range" in plan(assign.spare_slots(signals))


def test_references_are_not_broadcast(spark):
    refs = spark.createDataFrame([("TE-1", 1)], "reference string, ref_seq int")
    assert "BroadcastHashJoin" not in plan(match.exact(spark.createDataFrame([("te_1",)], "tag string"), refs))


def test_spellings_are_computed_once_a_row(spark):
    io = spark.createDataFrame([("t", "jb-1", "a.o", "i.s", "local")], "tag string, jb string, io_type string, safety string, location string").filter("tag > ''")
    cleaned = clean.clean(io)
    assert cleaned.select("tag", "jb", "io", "safety", "location").collect() == [("T", "JB-1", "AO", "IS", "LCP")]
    assert plan(cleaned.select("io")).split("== Physical Plan ==")[1].count("regexp_replace") <= 3


def test_kinds_are_written_once_a_query(spark):
    for name in ("x24_spare_counts", "j10_x24_counts_beside_labels", "j04_spare_counts_on_rows"):
        assert "FRT|NC" not in plan(queries.QUERIES[name](spark, "/root/testdata/sf0.001"))


def test_spares_and_demand_deal_the_signals_once(spark):
    columns = "seq long, tag string, jb string, io string, safety string, location string, terminal_1 string, terminal_2 string, src string, rank_io int, rank_safety int, rank_location int"
    signals = spark.createDataFrame([(k, "t", f"JB-{k % 4}", "AI", "IS", "MCC" if k % 3 else "FIELD", "T01", "T02", "", 1, 1, 1 + k % 3) for k in range(20)], columns)
    with_terminals, without = assign.with_hot_spares(signals), assign.with_hot_spares(signals, terminals=False)
    assert sorted(map(tuple, with_terminals.drop("terminal_1", "terminal_2").collect())) == sorted(map(tuple, without.collect())) and without.count() == 24
    assert "regexp" in plan(with_terminals) and "regexp" not in plan(without)  # no search for the boxes' last terminals
    assert plan(assign.demands(signals)).split("== Physical Plan ==")[1].count("Exchange hashpartitioning") == 1
