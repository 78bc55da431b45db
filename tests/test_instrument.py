"""Values that the instrument operators must give, and small brute-force models."""

import io
import math
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from tagwright.functions import rules, text
from tagwright.operators import assign, consolidate, dims, drawing, match, review, textmode
from tagwright.plans import queries
from tagwright.sources import workbooks


def test_indel_ratio():
    assert match.lev_ratio("PT", "PDT") == pytest.approx(0.8) and match.lev_ratio("TE-5223", "TE-5224") == pytest.approx(12 / 14)
    assert match.lev_ratio("", "") == 1 and match.lev_ratio("a", "") == 0


REFS = ["TE-5223", "11-FV-301", "21HS-001"]


def frame(spark, values, columns):
    return spark.createDataFrame(values, columns)


def test_verdicts(spark):
    refs = match.references(frame(spark, list(zip(REFS, range(3))), "reference string, ref_seq int"))
    tags = ["TE-5224", "11-FV-302", "21HS-002", "TE 5223", "1234", "PORTION", "X.TE-5223", "PT-5223"]
    got = {r["tag"]: r for r in match.verdicts(frame(spark, [(t,) for t in tags], "tag string"), refs).collect()}
    assert got["TE-5224"]["match_type"] == "similar" and 0.85 < got["TE-5224"]["score"] < 1 and got["TE-5224"]["closest"] == "TE-5223"
    assert (got["11-FV-302"]["closest"], got["21HS-002"]["closest"], got["TE 5223"]["match_type"]) == ("11-FV-301", "21HS-001", "exact")
    assert {got[t]["match_type"] for t in ("1234", "PORTION", "X.TE-5223", "PT-5223")} == {"unmatched"}
    strict = match.verdicts(frame(spark, [("TE-5224",)], "tag string"), refs, 0.99).first()
    assert strict["match_type"] == "unmatched_candidate" and strict["closest"] == "TE-5223"
    members = ["TE-522", "TE-123456A", "12-FV-302", "123-FV-98765B", "22HS-002", "te 5_2-AB12"]
    others = ["T-E-522", "TE-522-ABCDEF", "TE-522AB", "12FV", "HS-002", "TEX-5"]
    got = match.members(frame(spark, [(t,) for t in members + others], "tag string"), refs)
    assert {r["tag"] for r in got.collect()} == {"TE-522", "TE-123456A", "12-FV-302", "123-FV-98765B", "22HS-002"}
    ambiguous = match.references(frame(spark, [("TE-1234", 0), ("TE1-234", 1)], "reference string, ref_seq int"))
    assert match.exact(frame(spark, [("TE 1234",)], "tag string"), ambiguous).first()["reference"] is None


def test_parts_and_scores(spark):
    rows = ["11-FV-301-2B", "21HS-001", "TE-5223", "TE-12-34A", "TE-12-X9", "TE5223A", "-te_52 23.", "A.B-7", ""]
    got = [(r["p"]["prefix"], r["p"]["numbers"], r["p"]["suffix"]) for r in frame(spark, [(t,) for t in rows], "t string").select(match.parts(F.col("t")).alias("p")).collect()]
    assert got == [("FV", ["11", "301", "2"], "B"), ("21HS", ["001"], "HS"), ("TE", ["5223"], ""), ("TE", ["12", "34"], "A"), ("TE", ["12", "9"], "X"), ("TE", ["5223"], "A"), ("TE", ["5223"], ""), ("A", ["7"], ""), ("", [], "")]
    pairs = [("TE-5223", "TE-5223"), ("TE-5224", "TE-5223"), ("TE-5240", "TE-5223"), ("TE-5223", "XV-5223"), ("TE-12-34", "TE-12-40"), ("TE-5", "TE-500000"), ("TE-10", "TE-17")]
    want = [1, 0.35 + 0.6 * 0.8 + 0.05, 0.35 + 0.6 * 0.1 + 0.05, 0, 0.35 + 0.35 + 0.25 * 0.4 * (1 - 6 / 40 * 0.5) + 0.05, (0.35 + 0.06 + 0.05) * (1 - 0.3 * 5 / 9), 0.35 + 0.6 * 0.4 * (1 - 7 / 17 * 0.5) + 0.05]
    df = frame(spark, [(k, a, b, False) for k, (a, b) in enumerate(pairs)], "k int, tag string, reference string, same_family boolean")
    assert [r["score"] for r in match.scored(df).orderBy("k").collect()] == pytest.approx(want)


def test_indel_ratio_equals_the_table():
    rng = random.Random(3)
    for _ in range(300):
        a, b = ("".join(rng.choice("AB-1") for _ in range(rng.randrange(0, 12))) for _ in range(2))
        best = {(i, j): 0 for i in range(-1, len(a)) for j in range(-1, len(b))}
        for i in range(len(a)):
            for j in range(len(b)):
                best[i, j] = best[i - 1, j - 1] + 1 if a[i] == b[j] else max(best[i - 1, j], best[i, j - 1])
        want = 2 * best[len(a) - 1, len(b) - 1] / (len(a) + len(b)) if a or b else 1
        assert match.lev_ratio(a, b) == pytest.approx(want)


def test_verdicts_of_all_tags_read(spark, monkeypatch):
    refs = [(f"{p}-{n}", k) for k, (p, n) in enumerate((p, n) for p in ("TE", "PT", "PDT") for n in range(100, 400, 37))]
    tags = [f"{p}{sep}{n}" for p in ("TE", "PDT", "XX") for sep in "-_" for n in range(100, 400, 23)] + ["NC-1-2-C"]
    monkeypatch.setattr(queries, "_tags", lambda spark, sf: frame(spark, [(t,) for t in tags], "tag string"))
    monkeypatch.setattr(queries, "_refs", lambda spark, sf: frame(spark, refs, "reference string, ref_seq int"))
    got = {r["tag"]: r for r in queries.h16_match_verdicts(spark, "no tables").collect()}
    assert got.keys() == set(tags)
    of = {r.replace("-", ""): r for r, _ in refs}
    pairs = frame(spark, [(t, r, r.split("-")[0] == t.replace("_", "-").split("-")[0]) for t in tags for r, _ in refs], "tag string, reference string, same_family boolean")
    scores = {(r["tag"], r["reference"]): r["score"] for r in match.scored(pairs).collect()}
    for t in tags:
        if (key := t.replace("-", "").replace("_", "")) in of:
            assert (got[t]["match_type"], got[t]["closest"]) == ("exact", of[key])
        elif t[:2] in ("XX", "NC"):
            assert got[t]["match_type"] == "unmatched"
        else:
            score, _, closest = max((scores[t, r], -k, r) for r, k in refs)
            assert got[t]["score"] == pytest.approx(score) and got[t]["closest"] == closest
            assert got[t]["match_type"] == ("similar" if score >= match.THRESHOLD else "unmatched_candidate")


def test_candidates(spark):
    refs = match.references(frame(spark, [("LUSY-2474A", 0), ("USY-2482A", 1)], "reference string, ref_seq int"))
    patterns = match.compiled(match.families(refs))
    assert match.candidates("LUSY-99999B USY-1 USY-876543C XYZ-2474A", patterns) == ["LUSY-99999B", "USY-1", "USY-876543C"]


SPAN = "pdf string, page int, x int, y int, w int, h int, confidence double, seq long, text string"


def spans(spark, rows):
    return drawing.classified(frame(spark, [("p", 1, x, y, 100, 20, 0.99, k, t) for k, (x, y, t) in enumerate(rows)], SPAN))


def numbers(spark, rows):
    return {r["token"]: r["number"] for r in drawing.numbered(spans(spark, rows)).collect()}


def test_numbers_by_position(spark):
    assert numbers(spark, [(20, 100, "SPARE"), (20, 20, "SPARE"), (20, 60, "SPARE")]) == {"SPARE_2": 1, "SPARE_3": 2, "SPARE_1": 3}
    assert numbers(spark, [(20, 10, "TE-5223"), (20, 20, "TE-5223"), (20, 30, "SPARE"), (20, 40, "SPARE")]) == {"TE-5223": 1, "SPARE_1": 2, "SPARE_2": 3}
    assert numbers(spark, [(20, 10, "TE-5223"), (20, 20, "TE_5223")]) == {"TE-5223": 1, "TE_5223": 1}


def test_kinds(spark):
    got = {r["text"]: r["kind"] for r in spans(spark, [(0, 0, t) for t in ("02-Jul-2025", "IP65", "2025-07-02", "JB-101", "MC-7", "SPARE", "TE-5223", "NC-12-3", "BK12", "MC-1 JB-2")]).collect()}
    assert got == {"02-Jul-2025": "Unknown", "IP65": "Unknown", "2025-07-02": "Unknown", "JB-101": "JB", "MC-7": "MC", "SPARE": "SPARE", "TE-5223": "Tag", "NC-12-3": "Cable", "BK12": "Unknown", "MC-1 JB-2": "MC"}


def test_best_cable_and_units(spark):
    assert drawing.best_cable(spans(spark, [(0, 0, "NC-0-1-2-C-3-BL"), (0, 9, "NC-12-3-4-A-5-WHT")])).first()["cable"] == "NC-12-3-4-A-5-WHT"
    rows = frame(spark, [("FRS-12P x 1.5mm2",), ("12 PAIR",), ("3 CORE",), ("none",)], "t string").select(text.cable_unit(F.col("t")).alias("u")).collect()
    assert [r["u"] for r in rows] == ["12 pair", "12 pair", "3 core", None]


def test_fragments_and_thinning():
    assert (20, 30, 65, 20, "TE 5223") in drawing.joined_fragments([(20, 30, 20, 20, "TE"), (45, 30, 40, 20, "5223")])
    assert drawing.thin([(0, 0), (10, 5), (100, 0), (25, 14)]) == [True, False, True, False]


def test_dimensions(spark):
    row = frame(spark, [("Type 1", "FRONT", 1711.0, 52.0, 20.0, 300.0, 2.0, 2, 5.0, 4)], "type string, direction string, length double, top double, bottom double, reserved double, gap double, columns int, terminal_height double, rails int")
    got = {r["board"]: (r["share"], r["terminals"]) for r in dims.limits(row, dims.heights(spark)).collect()}
    assert got["Barrier Board (AI)"] == (2.9, 1308) and len(got) == 12
    back = row.select(dims.height_from_share(F.lit(2.9), *(F.col(c) for c in ("length", "top", "bottom", "reserved", "gap", "columns"))).alias("h")).first()["h"]
    assert back == pytest.approx(76.8, abs=0.2)


def test_even_split(spark):
    rows = [(n, c, i) for n in (1, 5, 16, 17, 33, 100) for c in (1, 2, 7, 16) for i in range(n)]
    df = frame(spark, rows, "n long, c long, i long")
    board, channel = assign.even_split(F.col("i"), F.col("n"), F.col("c"))
    for r in df.select("*", board.alias("b"), channel.alias("ch")).collect():
        boards = math.ceil(r["n"] / r["c"])
        sizes = [r["n"] // boards + (k < r["n"] % boards) for k in range(boards)]
        at = r["i"]
        k = 0
        while at >= sizes[k]:
            at -= sizes[k]
            k += 1
        assert (r["b"], r["ch"]) == (k, at + 1)


def test_packing_is_first_fit_by_falling_load():
    rng = random.Random(1)
    boxes = [(f"JB-{k:03d}", rng.choice(["IS", "NIS"]), rng.randrange(5, 300), [rng.randrange(0, 40) for _ in range(12)]) for k in range(60)]
    out = assign.pack(boxes)
    assert [p for _, _, p, _, _ in out] == list(range(60)) and {o[0] for o in out} == {b[0] for b in boxes}
    load = {b[0]: b[2] + sum(b[3][:8]) for b in boxes}
    assert all((-load[a[0]], a[0]) <= (-load[b[0]], b[0]) for a, b in zip(out, out[1:]))
    rails = {}
    for jb, cabinet, _, kind, _ in out:
        rails[cabinet] = rails.get(cabinet, 0) + next(b[2] for b in boxes if b[0] == jb)
        assert kind in ("OVERFLOW", "DEFAULT") or rails[cabinet] <= 800
    assert assign.pack(boxes) == assign.pack(list(reversed(boxes)))
    with pytest.raises(ValueError):
        assign.pool(assign.Config(plan=[("Type 9", "REAR", 1, 1)]))


def test_boxes_share_an_overflow_cabinet():
    out = assign.pack([("JB-A", "IS", 900, [100] + [0] * 11), ("JB-B", "IS", 850, [20] + [0] * 11)])
    assert [(jb, cabinet, kind) for jb, cabinet, _, kind, _ in out] == [("JB-A", "IS-A-01-OVERFLOW", "OVERFLOW"), ("JB-B", "IS-A-01-OVERFLOW", "OVERFLOW")]


SIGNALS = "seq long, tag string, jb string, io string, safety string, location string, terminal_1 string, terminal_2 string, src string, rank_io int, rank_safety int, rank_location int, spare_count int"


def signals(n=400, seed=11):
    rng = random.Random(seed)
    ios, places = ["AI", "AIR", "AOR", "AO", "DI", "DIR", "DO", "DOR"], ["FIELD", "MCC", "LCP", "UCP"]
    safe = {f"JB-{k:02d}": rng.choice(["IS", "NIS"]) for k in range(12)}
    rows = []
    for k in range(n):
        jb, io, place = rng.choice(list(safe)), rng.choice(ios), rng.choice(places)
        rows.append((k, f"T-{k}", jb, io, safe[jb], place, f"T{2 * k + 1:02d}", f"T{2 * k + 2:02d}", rng.choice(["", "SC"]), ios.index(io) + 1, 1 + (safe[jb] == "NIS"), places.index(place) + 1, int(jb[3:]) % 4))
    return rows


def test_allocation_equals_a_plain_reading(spark):
    config = assign.Config(channels={**assign.CHANNELS, "Terminal Board (DI)": 5})
    rows = signals()
    everything = dict(assign.run_all(frame(spark, rows, SIGNALS).withColumn("run_id", F.lit(7)), "run_id", config))
    active = [dict(zip([c.split()[0] for c in SIGNALS.split(", ")], r)) for r in rows]
    spares = []
    for key in sorted({(r["io"], r["safety"]) for r in active}):
        own = sorted((r for r in active if (r["io"], r["safety"]) == key), key=lambda r: (r["rank_location"], r["jb"], r["seq"]))
        boxes, needed, k = list(dict.fromkeys(r["jb"] for r in own)), math.ceil(0.2 * len(own)), 0
        while k < needed:
            jb = boxes[k % len(boxes)]
            spares.append({**next(r for r in own if r["jb"] == jb), "tag": "HOT_SPARE", "seq": 10**9 + k // len(boxes)})
            k += 1
    got = [r.asDict() for r in everything["signals"].collect()]
    assert sorted((r["jb"], r["io"], r["location"], r["signal_type"]) for r in got) == sorted([(r["jb"], r["io"], r["location"], "ACTIVE") for r in active] + [(r["jb"], r["io"], r["location"], "HOT_SPARE") for r in spares])
    where = {r["jb"]: r["cabinet"] for r in everything["packed"].collect()}
    want, free, stats = [], [], []
    for cabinet in set(where.values()):
        for base in assign.BASES:
            own = sorted((r for r in active + spares if where[r["jb"]] == cabinet and r["io"][:2] == base), key=lambda r: (r["rank_io"], r["rank_safety"], r["rank_location"], r["jb"], r["seq"]))
            if not own:
                continue
            kind = "Barrier" if cabinet.startswith("IS") else "Terminal"
            limit = config.channels.get(f"{kind} Board ({base})", config.channels[kind])
            boards = math.ceil(len(own) / limit)
            at = 0
            for k in range(boards):
                n = len(own) // boards + (k < len(own) % boards)
                name = f"{kind} Board ({base})-{k + 1:02d}"
                want += [(cabinet, name, c + 1, r["jb"], r["io"], r["tag"], own[0]["location"] == "MCC") for c, r in enumerate(own[at : at + n])]
                free += [(cabinet, name, c, own[at + n - 1]["jb"]) for c in range(n + 1, limit + 1)]
                at += n
            hot = sum(r["tag"] == "HOT_SPARE" for r in own)
            stats.append((cabinet, base, boards, len(own) - hot, hot, boards * limit - len(own)))
    assert sorted(tuple(r) for r in everything["allocated"].select("cabinet", "board", "channel", "jb", "io", "tag", "relay").collect()) == sorted(want)
    assert sorted(tuple(r) for r in everything["spare"].select("cabinet", "board", "channel", "jb").collect()) == sorted(free)
    assert sorted(tuple(r) for r in assign.cabinet_stats(everything["allocated"]).select("cabinet", "base", "boards", "active", "hot", "spare").collect()) == sorted(stats)
    used = {r["cabinet"]: r for r in everything["usage"].collect()}
    assert used.keys() == set(where.values()) and all(u["boxes"] == sum(c == name for c in where.values()) for name, u in used.items())
    assert all(u["rail_share"] <= 1 and u["pool_share"] <= 1 + 1e-9 and u["limiting_factor"].startswith("PERCENT_PER_BOARD" if u["pool_share"] > u["rail_share"] else "Rail") for u in used.values() if u["cabinet_type"] not in ("OVERFLOW", "DEFAULT"))


def test_capped_slots(spark):
    df = frame(spark, signals(), SIGNALS)
    got = [r.asDict() for r in assign.capped_slots(df, F.lit(0)).collect()]
    per = {}
    for r in got:
        per[r["jb"]] = per.get(r["jb"], 0) + r["spares"]
    assert all(n <= int(jb[3:]) % 4 for jb, n in per.items()) and sum(per.values()) > 0
    rows = assign.hot_spares(df, slots=assign.capped_slots(df, F.lit(0)).drop("run")).groupBy("jb").count().collect()
    assert {r["jb"]: r["count"] for r in rows} == per


def test_single_sided_cabinets_are_measured_by_the_limits_they_are_packed_by(spark):
    own, front = (800, (50.0,) * 12), (400, (5.0,) * 12)
    config = assign.Config(plan=[("Type 9", "SINGLE", 1, 1), ("Type 8", "SINGLE", 1, 2)], limits={("Type 9", "SINGLE"): own, ("Type 9", "FRONT"): front, ("Type 8", "REAR"): (300, (10.0,) * 12)})
    assert [p[2:] for p in assign.pool(config)] == [own, (300, (10.0,) * 12)]
    demand = spark.createDataFrame([("a", "NIS", 80, *([0] * 4), 16, *([0] * 7)), ("b", "NIS", 30, *([0] * 4), 16, *([0] * 7))], "jb string, safety string, rail_load int, " + ", ".join(f"{c} int" for c in assign.COUNTERS))
    packed = spark.createDataFrame([("a", "X", "Type 9", "SINGLE"), ("b", "Y", "Type 8", "SINGLE")], "jb string, cabinet string, cabinet_type string, direction string")
    got = {r["cabinet"]: (r["rail_limit"], r["pool_share"]) for r in assign.usage(demand, packed, config).collect()}
    assert got == {"X": (800, 0.5), "Y": (300, 0.1)}


def test_capped_spares_equal_plain_rounds():
    rng = random.Random(2)
    for _ in range(200):
        capacity = {f"j{k}": rng.randrange(4) for k in range(6)}
        groups = [(f"g{g}", rng.sample(list(capacity), rng.randrange(1, 6)), rng.randrange(9)) for g in range(4)]
        left, want = dict(capacity), {}
        for name, boxes, needed in groups:
            while needed and any(left[b] for b in boxes):
                for b in boxes:
                    if needed and left[b]:
                        left[b] -= 1
                        needed -= 1
                        want[name, b] = want.get((name, b), 0) + 1
        assert {(g, b): n for g, b, n in assign.hot_spares_capped(capacity, groups)} == want


def test_rules(spark):
    df = frame(spark, [(7,), (123,)], "x int")
    got = df.select(rules.template("W{x:02d}-{(x+1)*2}", F.col("x")).alias("t"), rules.terminals(F.col("x"), "{x}, SCR{x}, {x+1}").alias("u")).collect()
    assert [r["t"] for r in got] == ["W07-16", "W123-248"] and got[0]["u"] == ["7", "8"]
    for bad in ("__import__('os')", "x.y", "x**9", "f(x)"):
        with pytest.raises((ValueError, SyntaxError)):
            rules.arithmetic(bad, F.lit(1))
    assert rules.identifier_regex([]) == "(?!)"


def test_columns_headers_and_merge(spark):
    assert consolidate.resolve_columns(["Tag No", "Junction Box", "Remarks", "Area", "Cable Number"]) == {"tag": "Tag No", "jb": "Junction Box", "location": "Area", "cable": "Cable Number", "description": "Remarks"}
    cells = frame(spark, [("f", "s", 0, ["Report"]), ("f", "s", 2, ["Tag No", "JB"]), ("f", "t", 0, ["x"])], "file string, sheet string, row int, cells array<string>")
    assert {r["sheet"]: r["header"] for r in consolidate.header_row(cells).collect()} == {"s": 2, "t": 0}


def test_positions(spark):
    rows = frame(spark, [(1, k, "JB", k) for k in range(1, 5)], "run_id long, id long, jb string, row_index long")
    new = frame(spark, [(1, 99, "JB", 3)], "run_id long, id long, jb string, row_index long")
    assert [r["id"] for r in review.inserted(rows, new).orderBy("row_index").collect()] == [1, 2, 99, 3, 4]
    m = frame(spark, [({"a": "1", "b": "2"}, {"b": None})], "o map<string,string>, i map<string,string>")
    assert m.select(review.unwrapped(F.col("o"), F.col("i")).alias("m")).first()["m"] == {"a": "1", "b": None}


def test_word_runs(spark):
    words = frame(spark, [(1, 1, 1, "TE"), (1, 1, 2, "-52"), (1, 1, 3, "23"), (1, 1, 5, "x"), (1, 2, 1, "y")], "page int, line int, word_no int, text string")
    assert {r["text"] for r in textmode.neighbours(words).collect()} == {"TE-52", "-5223", "TE-5223"}
    assert frame(spark, [("Ünit_ 1",)], "t string").select(textmode.unicode_normal("t").alias("n")).first()["n"] == "UNIT-1"


def workbook(rows):
    sheet = "".join(f'<row r="{r + 1}">' + "".join(f'<c r="{chr(65 + c)}{r + 1}" t="inlineStr"><is><t>{v}</t></is></c>' for c, v in enumerate(row) if v) + "</row>" for r, row in enumerate(rows))
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="IO" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData>{sheet}</sheetData></worksheet>')
    return out.getvalue()


def test_workbooks(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(workbook([["Tag No", "JB"], ["TE-1", ""], ["", "JB-2"]]))
    (tmp_path / "b.xlsx").write_bytes(b"no workbook")
    rows = workbooks.workbook_rows(spark, str(tmp_path)).collect()
    assert [r["cells"] for r in sorted((r for r in rows if r["error"] is None), key=lambda r: r["row"])] == [["Tag No", "JB"], ["TE-1"], [None, "JB-2"]]
    assert sum(r["error"] is not None for r in rows) == 1
    assert workbooks.hashed_files(spark, str(tmp_path)).count() == 2


def test_page_samples(spark):
    got = frame(spark, [(100,), (1,), (3,)], "n long").select(workbooks.sample_indices(F.col("n"), 5).alias("s"), workbooks.effective_dpi(F.col("n")).alias("d")).collect()
    assert [r["s"] for r in got] == [[0, 20, 40, 50, 60], [0], [0, 1, 2]] and got[0]["d"] == 300


def test_log_stream(spark, tmp_path):
    from tagwright.streaming import logs

    frame(spark, [(1, "INFO"), (2, "WARN")], "id int, level string").write.parquet(str(tmp_path / "in"))
    q = logs.append_log(spark.readStream.schema("id int, level string").parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination()
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_spare_counts_and_usable_pages(spark):
    s = "pdf string, page int, x int, y int, w int, h int, text string, kind string, token string, seq int"
    rows = [
        ("a", 1, 0, 0, 50, 20, "2 SPARE", "SPARE", "2 SPARE", 1), ("a", 2, 0, 0, 50, 20, "SPARE", "SPARE", "SPARE", 1), ("a", 2, 60, 0, 9, 20, "4", "Unknown", "4", 2),
        ("a", 3, 0, 0, 50, 20, "3 SPARE", "SPARE", "3 SPARE", 1), ("a", 3, 0, 90, 50, 20, "SPARE", "SPARE", "SPARE", 2), ("a", 4, 0, 0, 9, 9, "�\x01ab", "Unknown", "", 1), ("a", 5, 0, 0, 9, 9, "- \t", "Unknown", "", 1),
    ]
    spans = frame(spark, rows, s)
    assert {(r["page"], r["seq"]): r["spares"] for r in drawing.spare_counts(spans).collect()} == {(1, 1): 2, (2, 1): 4, (3, 1): 1, (3, 2): 1}
    assert {r["page"]: r["usable"] for r in drawing.usable_pages(spans).collect()} == {1: True, 2: True, 3: True, 4: False, 5: False}


def test_tag_looks(spark):
    texts = ["TE-5223", "NOTE", "IP65", "12-JUL-2025", "PT-1014-A", "", None]
    got = frame(spark, [(t,) for t in texts], "t string").select(drawing.looks_like_tag(F.col("t")).alias("k")).collect()
    assert [r["k"] for r in got] == [True, False, False, False, True, False, False]
