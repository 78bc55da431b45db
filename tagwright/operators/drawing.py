"""Spans read from drawings: kinds, numbering by position, neighbours, page and document checks.

spans: pdf, page, x, y, w, h, text, confidence, seq.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X

# Default patterns (Java regular expressions, without regard to case), stop words, floors.
TAG = r"(?i)\b([A-Z]{2,5}[-._][0-9]{2,4}(?:[-._][0-9]{1,4})?(?:[-._][A-Z])?(?:[A-Z]{1,2})?(?:\s+[0-9]{1,3})?)\b"
JB = r"(?i)\b(JB[-_]?[A-Z]*[-_]?[0-9]{1,6}(?:[-_]?[0-9]{1,4})?)\b"
MC = r"(?i)\b(MC[-_]?[A-Z]*[-_]?[0-9]{1,6}(?:[-_]?[0-9]{1,4})?)\b"
SPARE = r"(?i)\b(SPARE)(?:\s*[0-9]+)?\b"
CABLE = r"(?i)\b((?:FRT|NC|CBL|CAB|WIR)[-_][A-Z0-9]{1,6}(?:[-_][A-Z0-9]{1,6})*(?:\.[0-9]+)?(?:mm²|mm2|Px|PR|CR|pair|core)?)\b"
WIRE = r"(?i)^(BK|WT|RD|BL|GN|YL|BR|GR|OG|PK|PR|WH|GY)[0-9]{1,4}$"
DATE = r"(?i)^[0-9]{1,4}[-/.]([0-9]{1,2}|[A-Z]{3})[-/.][0-9]{2,4}$"
STOP_WORDS = [
    "PAGE", "SHEET", "REV", "REVISION", "DATE", "DRAWN", "CHECKED", "APPROVED", "SCALE", "SIZE", "DWG", "DWG NO", "DRAWING",
    "BK", "WT", "RD", "BL", "GN", "YL", "OR", "BR", "GR", "VI", "BLACK", "WHITE", "RED", "BLUE", "GREEN", "YELLOW", "ORANGE",
    "BROWN", "GRAY", "GREY", "VIOLET", "DCS", "PLC", "ESD", "F&G", "SIS", "NO", "TYPE", "QTY", "REF", "NOTE", "NOTES",
    "TERMINAL", "TERMINALS", "BLOCK", "BOARD", "CHANNEL", "CH", "CARD", "PROJECT", "CLIENT", "CONTRACTOR", "N/A", "NA", "TBD",
    "TYP", "TYPICAL", "CONT", "CONTINUED", "SECTION", "DETAIL",
]
LEAST_CONFIDENCE = 0.30


def kept(spans: DataFrame, least: float = LEAST_CONFIDENCE) -> DataFrame:
    """Spans with a usable confidence and text; boxes at least one pixel wide and high."""
    return spans.filter((F.col("confidence") >= least) & (F.length(F.trim("text")) > 0)).withColumns({"w": F.greatest(F.lit(1), "w"), "h": F.greatest(F.lit(1), "h")})


def non_tag(c: Column) -> Column:
    """Dates, protection ratings, stop words, wires, bare numbers, anything under four characters."""
    u = F.upper(F.trim(c))
    return u.rlike(DATE) | u.rlike("^IP[0-9]{2}$") | u.isin(STOP_WORDS) | u.rlike(WIRE) | u.rlike("^[0-9]{1,4}$") | (F.length(u) < 4) | u.rlike(JB) | u.rlike(MC) | u.rlike(SPARE) | u.rlike(CABLE)


def looks_like_tag(c: Column) -> Column:
    """A tag by pattern, with a digit, that is no date, rating, stop word, wire, box, cable or bare number."""
    u = F.upper(F.trim(c))
    return F.coalesce(u.rlike(TAG) & u.rlike("[0-9]") & ~non_tag(u), F.lit(False))


def with_spaced_suffix(text: Column, tag: Column) -> Column:
    """The tag, with the number of up to three digits that alone follows it in its span's text, set off by spaces."""
    u = F.regexp_replace(F.upper(text), r"^\s+|\s+$", "")
    after = F.substring(u, F.length(tag) + 1, F.length(u))
    return F.when(u.startswith(F.upper(tag)) & after.rlike(r"^\s+[0-9]{1,3}$"), F.concat(tag, F.lit(" "), F.regexp_extract(after, "[0-9]+", 0))).otherwise(tag)


def with_area_prefix(jb: Column, examples: list[str]) -> Column:
    """A box's name with the area number of the first configured example (digits, then letters) whose letters it begins with."""
    out = None
    for example in examples:
        found = re.fullmatch(r"[^A-Z0-9]*([0-9]+)[^A-Z0-9]*([A-Z]+)[^A-Z0-9]*", example)
        if found:
            area, letters = found.groups()
            holds, put = jb.startswith(letters) & ~jb.startswith(area), F.concat(F.lit(area), jb)
            out = F.when(holds, put) if out is None else out.when(holds, put)
    return jb if out is None else out.otherwise(jb)


def written_spares(c: Column) -> Column:
    """The number of one or two digits right before a spare label, else right after it; null without one."""
    parts = r"(?is)^(.*?)\bSPARE(?:\s*[0-9]+)?\b(.*)$"
    number = lambda side, p: F.nullif(F.regexp_extract(F.regexp_extract(c, parts, side), p, 1), F.lit(""))
    return F.coalesce(number(1, r"(?:^|\s)([0-9]{1,2})\s*$"), number(2, r"^\s*([0-9]{1,2})(?:\s|$)")).cast("int")


def spare_counts(spans: DataFrame) -> DataFrame:
    """(pdf, page, seq, spares): what each spare label stands for. Where a page has one label, the number in its text, else the nearest on
    its row; one otherwise."""
    s = spans.filter("kind = 'SPARE'")
    labels = s.groupBy("pdf", "page").agg(F.count("*").alias("labels"))
    near = nearest_count(spans).withColumnRenamed("spares", "near")
    found = s.select("pdf", "page", "seq", written_spares(F.col("text")).alias("own")).join(labels, ["pdf", "page"]).join(near, ["pdf", "page", "seq"], "left")
    return found.select("pdf", "page", "seq", F.when(F.col("labels") == 1, F.coalesce("own", "near", F.lit(1))).otherwise(1).alias("spares"))


def usable_pages(spans: DataFrame, most: float = 0.05) -> DataFrame:
    """(pdf, page, usable): pages whose text layer has a letter or digit, and no more than a share of characters that can't be printed."""
    broken = F.length("text") - F.length(F.regexp_replace("text", r"[\p{C}\x{FFFD}&&[^\t-\r\x1c-\x1f\x85]]", ""))
    p = spans.groupBy("pdf", "page").agg(F.sum(F.length("text")).alias("n"), F.sum(broken).alias("broken"), F.coalesce(F.bool_or(F.col("text").rlike(r"[\p{L}\p{N}]")), F.lit(False)).alias("some"))
    return p.select("pdf", "page", (F.col("some") & (F.col("broken") <= most * F.col("n"))).alias("usable"))


def pair_status(pair: Column, highest: Column) -> Column:
    """Whether a cable's pair number equals the highest number of its page's tags. The texts are fixed values."""
    off = F.format_string("WARNING: Pair number (%d) != Max Tag number (%d)", pair, highest)
    return (
        F.when(pair.isNull(), "WARNING: Could not extract pair number from cable description")
        .when(F.coalesce(highest, F.lit(0)) <= 0, "WARNING: No tag numbers found").when(pair == highest, "OK").otherwise(off)
    )


def pair_consistency(spans: DataFrame) -> DataFrame:
    """(pdf, page, pair, highest, status) for every page: its best cable's pair number against its tags' highest number."""
    highest = numbered(spans).filter("kind = 'Tag'").groupBy("pdf", "page").agg(F.max("number").alias("highest"))
    pairs = best_cable(spans).select("pdf", "page", X.pair_number(F.col("cable")).alias("pair"))
    pages = spans.select("pdf", "page").distinct().join(highest, ["pdf", "page"], "left").join(pairs, ["pdf", "page"], "left")
    return pages.select("pdf", "page", "pair", "highest", pair_status(F.col("pair"), F.col("highest")).alias("status"))


def number_consistency(inter: DataFrame) -> DataFrame:
    """(pdf, page, highest, consistent): whether the numbers of a page's intermediate rows are exactly 1 to the highest."""
    return inter.groupBy("pdf", "page").agg(F.max("number").alias("highest"), (F.countDistinct("number") == F.max("number")).alias("consistent"))


def document_label(c: Column) -> Column:
    """The class of a document by its classifier's label; diagrams unless the label speaks of a table."""
    return F.when(F.lower(F.trim(c)).contains("table"), "table").otherwise("diagrams")


def _upper(pattern: str) -> str:
    """A pattern for texts in capitals, which it holds in exactly when the pattern without regard to case does."""
    return re.sub(r"mm|x\b|pair|core", lambda m: m[0].upper(), pattern.removeprefix("(?i)"))


def kind(c: Column) -> Column:
    """The first of JB, MC, SPARE, Tag, Cable that a span's text holds; an MC at its start owns a span with a JB further on. A tag's number
    may have any length. What no text with a tag in it can be (stop words, wires, ratings, bare numbers) isn't asked again, and a pattern is
    only tried on texts that hold its letters."""
    u = F.upper(F.trim(c))
    holds = lambda p: u.rlike(_upper(p))
    box, motor = u.contains("JB") & holds(JB), u.contains("MC") & holds(MC)
    tag = (u.rlike("^[A-Z]{2,5}[-_][0-9]+$") | holds(TAG)) & ~holds(DATE)
    return (
        F.when(box, F.when(u.startswith("MC") & holds("^" + _upper(MC)), "MC").otherwise("JB")).when(motor, "MC").when(u.contains("SPARE") & holds(SPARE), "SPARE")
        .when(u.rlike("FRT|NC|CBL|CAB|WIR") & holds(CABLE), "Cable").when(tag, "Tag").otherwise("Unknown")
    )


def classified(spans: DataFrame) -> DataFrame:
    u = F.upper(F.trim("text"))
    code = lambda p: X.code_token(F.regexp_extract(u, _upper(p), 1))
    return spans.withColumn("kind", kind(F.col("text"))).withColumn("token", F.when(F.col("kind") == "JB", code(JB)).when(F.col("kind") == "MC", code(MC)).otherwise(u))


def with_numbers(items: DataFrame) -> DataFrame:
    """items (tags and spares) with key and number, by windows over their pages: spellings of one tag share a number, each spare has its own.
    Nothing is dealt again where a page's rows are together already."""
    spare = F.col("kind") == "SPARE"
    nth = F.row_number().over(Window.partitionBy("pdf", "page", "kind").orderBy("seq", "y", "x"))
    s = items.withColumn("nth", F.when(spare, nth)).withColumn("key", F.when(spare, F.concat(F.lit("SPARE_"), "nth")).otherwise(X.canonical_tag(F.col("token")))).drop("nth")
    s = s.withColumn("p", F.min(F.struct("y", "x", spare.alias("spare"), "seq")).over(Window.partitionBy("pdf", "page", "key")))
    return s.withColumn("number", F.dense_rank().over(Window.partitionBy("pdf", "page").orderBy("p", "key"))).drop("p")


def numbered(spans: DataFrame) -> DataFrame:
    """(pdf, page, token, kind, number): tags and spares of a page numbered by position. Spellings of one tag share a number, each spare
    has its own. Positions that tie take tags before spares, then input order. Spans are dealt once, by page."""
    s = with_numbers(spans.filter("kind in ('Tag', 'SPARE')").select("pdf", "page", "y", "x", "seq", "kind", "token").repartition("pdf", "page"))
    return s.select("pdf", "page", F.when(F.col("kind") == "SPARE", F.col("key")).otherwise(F.col("token")).alias("token"), "kind", "number").distinct()


def page_metrics(spans: DataFrame) -> DataFrame:
    n = lambda k: F.count_if(F.col("kind") == k).alias(f"n_{k.lower()}")
    return spans.groupBy("pdf", "page").agg(F.count("*").alias("n"), *(n(k) for k in ("JB", "MC", "SPARE", "Tag", "Cable", "Unknown")))


def duplicates_within(spans: DataFrame, of: str = "Tag") -> DataFrame:
    """Items of a document on more than one page, with the pages."""
    d = spans.filter(F.col("kind") == of).groupBy("pdf", X.canonical_tag(F.col("token")).alias("item")).agg(F.sort_array(F.collect_set("page")).alias("pages"))
    return d.filter(F.size("pages") > 1).select("pdf", "item", F.size("pages").cast("bigint").alias("n_pages"), F.array_join(F.transform("pages", lambda p: p.cast("string")), ",").alias("pages"))


def duplicates_across(spans: DataFrame) -> DataFrame:
    d = spans.filter("kind = 'Tag'").groupBy(X.canonical_tag(F.col("token")).alias("item")).agg(F.countDistinct("pdf").alias("n_pdfs"), F.min("pdf").alias("first_pdf"))
    return d.filter("n_pdfs > 1")


def warnings(spans: DataFrame) -> DataFrame:
    """(warning, severity, pdf, page): pages without a box though they hold tags or spares, and pages with several boxes."""
    p = spans.groupBy("pdf", "page").agg(F.countDistinct(F.when(F.col("kind") == "JB", F.col("token"))).alias("boxes"), F.count_if(F.col("kind").isin("Tag", "SPARE")).alias("items"))
    w = F.when(F.col("boxes") > 1, F.lit("MULTIPLE_JB")).when((F.col("boxes") == 0) & (F.col("items") > 0), F.lit("JB_NOT_FOUND"))
    return p.select(w.alias("warning"), F.when(w == "MULTIPLE_JB", "HIGH").otherwise("MEDIUM").alias("severity"), "pdf", "page").filter("warning is not null")


def cable_rank(token: Column) -> Column:
    """What the best of a page's cables has most of: the sum of its numbers, the largest number, length, and the first place."""
    n = F.transform(F.regexp_extract_all(token, F.lit("[0-9]+"), F.lit(0)), lambda d: d.cast("bigint"))
    return F.struct(F.aggregate(n, F.lit(0).cast("bigint"), lambda a, x: a + x), F.coalesce(F.array_max(n), F.lit(0).cast("bigint")), F.length(token), -F.col("y"), -F.col("x"), -F.col("seq"))


def best_cable(spans: DataFrame) -> DataFrame:
    """Per page the cable text with the largest sum of its numbers, then the largest number, then the longest, then the first."""
    return spans.filter("kind = 'Cable'").groupBy("pdf", "page").agg(F.max_by("token", cable_rank(F.col("token"))).alias("cable"))


def nearest_count(spans: DataFrame) -> DataFrame:
    """For each spare label the nearest number beside it on its row, not further than one and a half heights. Rows are matched by bucket of y."""
    s = spans.filter("kind = 'SPARE'").select("pdf", "page", "seq", "x", "y", "w", "h")
    n = spans.filter(F.col("token").rlike("^[0-9]{1,2}$")).select("pdf", "page", F.col("x").alias("nx"), F.col("y").alias("ny"), F.col("w").alias("nw"), F.col("token").cast("int").alias("value"))
    size = F.lit(64)
    left = s.withColumn("bucket", F.explode(F.sequence(F.floor((F.col("y") - F.col("h")) / size), F.floor((F.col("y") + F.col("h")) / size))))
    right = n.withColumn("bucket", F.floor(F.col("ny") / size))
    gap = F.greatest(F.col("nx") - F.col("x") - F.col("w"), F.col("x") - F.col("nx") - F.col("nw"))
    j = left.join(right, ["pdf", "page", "bucket"]).withColumn("gap", gap).filter((F.abs(F.col("ny") - F.col("y")) <= F.col("h") / 2) & F.col("gap").between(0, 1.5 * F.col("h")))
    return j.groupBy("pdf", "page", "seq").agg(F.min(F.struct("gap", "value"))["value"].alias("spares"))


def thin(spares: list[tuple[float, float]], dx: float = 30, dy: float = 15) -> list[bool]:
    """Which spare labels stay: each unless it lies close to one that stays before it."""
    stay: list[tuple[float, float]] = []
    out = []
    for x, y in spares:
        keep = not any(abs(x - a) < dx and abs(y - b) < dy for a, b in stay)
        out.append(keep)
        if keep:
            stay.append((x, y))
    return out


def thinned(spans: DataFrame, dx: float = 30, dy: float = 15) -> DataFrame:
    """Spare labels without those close to an earlier one of their page in reading order. A page's labels come side by side in one task, and
    only those that stay and lie within dy above the one at hand are remembered, so neither many pages nor a large one costs more."""

    def stay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page, near = None, deque()
        for batch in batches:
            keep = []
            for pdf, number, x, y in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if (pdf, number) != page:
                    page, near = (pdf, number), deque()
                if x is None or y is None:
                    keep.append(True)
                    continue
                while near and y - near[0][1] >= dy:
                    near.popleft()
                keep.append(not any(abs(x - a) < dx for a, _ in near))
                if keep[-1]:
                    near.append((x, y))
            yield batch.filter(pa.array(keep, pa.bool_()))

    s = spans.filter("kind = 'SPARE'").select("pdf", "page", "x", "y", "seq")
    return s.repartition("pdf", "page").sortWithinPartitions("pdf", "page", "y", "x", "seq").mapInArrow(stay, s.schema)


def joined_fragments(boxes: list[tuple[int, int, int, int, str]], most: int = 7) -> list[tuple[int, int, int, int, str]]:
    """Spans of a row that follow one another closely, put together: every run of a span and up to seven followers, from the left.
    boxes: (x, y, w, h, text). A follower overlaps the run's height by half and begins between 2 before and 1.5 heights after its end."""
    out = []
    ordered = sorted(boxes, key=lambda b: (b[1], b[0]))
    for k, (x, y, w, h, text) in enumerate(ordered):
        end, low, high, words = x + w, y, y + h, [text]
        for a, b, c, d, t in sorted(ordered[:k] + ordered[k + 1 :], key=lambda o: o[0]):
            over = min(high, b + d) - max(low, b)
            if a >= x and over >= 0.5 * min(h, d) and -2 <= a - end <= 1.5 * h and len(words) <= most:
                words.append(t)
                end, low, high = a + c, min(low, b), max(high, b + d)
                out.append((x, low, end - x, high - low, " ".join(words)))
    return out


def envelope(spans: DataFrame, by: list[str]) -> DataFrame:
    return spans.groupBy(*by).agg(F.min("x").alias("x"), F.min("y").alias("y"), (F.max(F.col("x") + F.col("w")) - F.min("x")).alias("w"), (F.max(F.col("y") + F.col("h")) - F.min("y")).alias("h"), F.min("confidence").alias("confidence"))


def intermediate(spans: DataFrame) -> DataFrame:
    """One row per tag spelling and spare of every page with at most one box: pdf, page, jb, type, item, number, wire codes, cable."""
    numbers = numbered(spans)
    box = spans.groupBy("pdf", "page").agg(F.collect_set(F.when(F.col("kind") == "JB", F.col("token"))).alias("b")).filter(F.size("b") <= 1)
    name = F.coalesce(F.get("b", F.lit(0)), F.concat(F.lit("JB_NOT_FOUND (page "), F.col("page").cast("string"), F.lit(")")))
    out = numbers.join(box.select("pdf", "page", name.alias("jb")), ["pdf", "page"]).join(best_cable(spans), ["pdf", "page"], "left")
    two = F.lpad(F.col("number").cast("string"), 2, "0")
    code = lambda p: F.concat(F.lit(p), F.when(F.col("number") > 99, F.col("number").cast("string")).otherwise(two))
    return out.select("pdf", "page", "jb", F.col("kind").alias("type"), F.col("token").alias("item"), "number", code("BK").alias("wire_1"), code("WT").alias("wire_2"), F.coalesce("cable", F.lit("")).alias("cable"))


def enriched(io: DataFrame, inter: DataFrame) -> DataFrame:
    """Every I/O row with the first intermediate row (pdf, page, number) of its canonical tag; unmatched rows keep their own values."""
    t = inter.filter("type = 'Tag'").withColumn("key", X.canonical_tag(F.col("item")))
    first = t.groupBy("key").agg(F.min(F.struct("pdf", "page", "number", "jb", "item")).alias("f"))
    j = io.withColumn("key", X.canonical_tag(F.col("tag"))).join(first, "key", "left")
    return j.select("seq", "tag", F.coalesce("f.jb", "jb").alias("jb"), F.col("f.pdf").alias("pdf"), F.col("f.page").alias("page"), F.col("f.number").alias("number"), F.col("f").isNotNull().alias("matched"))
