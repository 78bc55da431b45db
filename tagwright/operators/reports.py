"""Tables that a run hands out: verdicts with reasons, the intermediate and the final table, and the report of warnings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import rules
from ..sources.tables import stored
from . import drawing, match

# Column names and the texts that readers of the tables look for.
ITEM = "Tag/SPARE"
PROFILE = "IO-independent OCR profile candidate"
ACTIONS = {
    "PAGE_SKIPPED_MULTIPLE_JB": "Manually review the page and choose the correct JB, or split the page so it contains a single JB.",
    "JB_NOT_FOUND": "Check the page header (top of page).",
    "DUPLICATE_JB": "Verify the JB label on each listed page.",
    "DUPLICATE_TAG": "Verify the tag is intended to be on multiple pages.",
    "ACROSS": "Verify the tag is expected across PDFs.",
}
NO_WARNINGS = ("NONE", "N/A", "N/A", "N/A", 0, "SUCCESS", "No JB-not-found, duplicate-JB, or duplicate-tag issues detected.", "No action needed.")
WARNING_COLUMNS = ["Warning_Type", "Item", "PDF_Name", "Pages", "Tag_Count", "Severity", "Description", "Action"]


def _percent(score: Column) -> Column:
    return F.format_string("%.1f%%", 100 * score)


def with_reasons(verdicts: DataFrame) -> DataFrame:
    """verdicts (tag, match_type, score, closest, profile_score: null unless the profile recovered the tag) with the reason of each. A
    recovered tag keeps a verdict only if it is a similar one; any other leaves it a candidate without one, as the profile alone speaks for it."""
    kind, near, recovered = F.col("match_type"), F.col("closest"), F.col("profile_score").isNotNull()
    alone = recovered & (kind != "similar")
    known = F.concat(F.when(near == "", "none").otherwise(near), F.lit(" ("), _percent(F.col("score")), F.lit(")"))
    reason = (
        F.when(alone, F.concat(F.format_string(PROFILE + " (shape score %.2f); ", "profile_score"), F.lit("not matched to an IO tag; review required.")))
        .when(recovered, F.concat(F.lit(PROFILE + "; legacy structural similarity: "), known, F.lit("; review required.")))
        .when(kind == "exact", F.concat(F.lit("Exact IO List match: "), near))
        .when(kind == "similar", F.concat(F.lit("Not in IO List; closest tag: "), known, F.lit(". Review required.")))
        .otherwise(F.concat(F.lit("Matches learned IO List pattern but is absent; closest tag: "), known, F.lit(". Review required.")))
    )
    out = verdicts.withColumn("reason", reason)
    blank = lambda c, value: F.when(alone, value).otherwise(F.col(c))
    return out.withColumns({"match_type": blank("match_type", F.lit("unmatched_candidate")), "score": blank("score", F.lit(0.0)), "closest": blank("closest", F.lit(""))})


def judged(tags: DataFrame, refs: DataFrame, recovered: DataFrame | None = None) -> DataFrame:
    """tag, match_type, score, closest, profile_score, reason, in_family of each different tag. recovered: tag and score by the profile."""
    found = match.verdicts(tags, refs)
    family = match.members(tags, refs).withColumn("in_family", F.lit(True))
    found = found.join(family, "tag", "left").withColumn("in_family", F.coalesce("in_family", F.lit(False)))
    if recovered is None:
        return with_reasons(found.withColumn("profile_score", F.lit(None).cast("double")))
    scores = recovered.groupBy("tag").agg(F.max("score").alias("profile_score"))
    return with_reasons(found.join(scores, "tag", "left"))


def intermediate_table(spans: DataFrame, verdicts: DataFrame, motors: DataFrame | None = None, wires: str = "BK{x:02d}, WT{x:02d}", terminals: str | None = None, scr: str | None = None) -> DataFrame:
    """One row for each tag spelling and each spare of every page with at most one box, with all columns of the report, in order of document,
    page and number. spans: classified; verdicts: as ``judged`` gives them, and tags without one are unmatched; motors: pdf, page, motor.

    Pages with several boxes are left out (the warnings name them); a page with items and no box has a stand-in name and a warning in each
    row. Spares have no verdict: their columns of it are null. No spans give no rows.

    The report's texts are made last, so no shuffle holds them."""
    return intermediate_rows(spans, verdicts, motors).select(*(c.alias(name) for name, c in intermediate_columns(wires, terminals, scr).items()))


def intermediate_rows(spans: DataFrame, verdicts: DataFrame, motors: DataFrame | None = None) -> DataFrame:
    """The rows of the intermediate table, in order, with what ``intermediate_columns`` makes its texts from. Tags meet their verdicts; then all
    that a page has is dealt once, by ranges of pages. Boxes, cables, motors and numbers are windows over pages there, which are in order already."""
    own = verdicts.select(F.col("tag").alias("token"), "match_type", "score", "closest", "reason", "in_family", F.lit(True).alias("judged"))
    place = ["pdf", "page", "y", "x", "seq", "kind", "token"]
    raw = F.when(F.col("kind") == "Cable", F.upper(F.trim("text"))).alias("raw")
    rows = spans.filter("kind = 'Tag'").select(*place).join(own, "token", "left").unionByName(spans.filter("kind in ('SPARE', 'JB', 'Cable')").select(*place, raw), allowMissingColumns=True)
    if motors is not None:
        rows = rows.unionByName(motors.select("pdf", "page", F.lit("motor").alias("kind"), F.col("motor").alias("token")), allowMissingColumns=True)
    of_page = Window.partitionBy("pdf", "page")
    of = lambda kind, c: F.when(F.col("kind") == kind, c)
    best = lambda c: F.max_by(c, of("Cable", drawing.cable_rank(F.col(c)))).over(of_page)
    rows = rows.repartitionByRange("pdf", "page").withColumns({
        "box": F.min(of("JB", F.col("token"))).over(of_page), "other_box": F.max(of("JB", F.col("token"))).over(of_page), "motor": F.max(of("motor", F.col("token"))).over(of_page),
        "cable": best("token"), "raw_cable": best("raw"),
    })
    rows = drawing.with_numbers(rows.filter(F.col("kind").isin("Tag", "SPARE") & (F.col("box").isNull() | (F.col("box") == F.col("other_box")))))
    return rows.select("pdf", "page", "number", "kind", "key", "token", "box", "motor", "cable", "raw_cable", "match_type", "score", "closest", "reason", "in_family", "judged").distinct().orderBy("pdf", "page", "number")


def intermediate_columns(wires: str = "BK{x:02d}, WT{x:02d}", terminals: str | None = None, scr: str | None = None) -> dict[str, Column]:
    """The intermediate table's columns, by name, over its rows."""
    page, missing = F.col("page").cast("string"), F.col("box").isNull()
    jb = F.when(missing, F.concat(F.lit("JB_NOT_FOUND (page "), page, F.lit(")"))).otherwise(F.col("box"))
    x, spare, known = F.col("number"), F.col("kind") == "SPARE", F.coalesce("judged", F.lit(False))
    item = F.col("token")
    ends, screen = _terminals(x, terminals, scr)
    wire = rules.wire_pair(x, wires)
    status = (
        F.when(spare, "Assigned (Position-based)").when(~known, "Assigned")
        .when(F.col("match_type") == "exact", F.format_string("Exact Match (score: %.3f)", "score"))
        .when(F.col("match_type") == "similar", F.format_string("Similar Match (score: %.3f)", "score"))
        .otherwise("Not in IO List (pattern candidate)")
    )
    what = F.when(spare, F.concat(F.lit("SPARE "), item)).otherwise(F.concat(F.lit("tag "), item))
    unboxed = F.concat(F.lit("JB_NOT_FOUND: page "), page, F.lit(" has "), what, F.lit(" but no JB was detected on this page. "), F.when(spare, "SPARE").otherwise("Tag"), F.lit(" was NOT assigned to any JB."))
    doubt = F.when(~spare & known & (F.col("match_type") != "exact"), F.col("reason")).otherwise("")
    warning = F.concat(doubt, F.when(missing, F.concat(F.when(spare, "").otherwise(" "), unboxed)).otherwise(""))
    of_tag = lambda c, default: F.when(~spare, F.coalesce(c, F.lit(default)))
    part = lambda a, k: F.coalesce(F.get(a, F.lit(k)), F.lit(""))
    return {
        "PDF_Name": F.col("pdf"), "Page": F.col("page"), "JB": jb, "MC": F.coalesce("motor", F.lit("")), ITEM: item, "Tag_Number": x, "Wire_Code_1": part(wire, 0), "Wire_Code_2": part(wire, 1),
        "Terminal_First_Number": part(ends, 0), "Terminal_Second_Number": part(ends, 1), "Cable_Code": F.coalesce("cable", F.lit("")), "SCR_Terminal_Number": screen,
        "Cable_Description": F.coalesce("raw_cable", "cable", F.lit("")), "Type": F.col("kind"), "Tag_Number_Status": status, "Warning": warning,
        "Match_Type": of_tag(F.col("match_type"), "unmatched"), "Similarity_Percent": of_tag(F.round(100 * F.col("score"), 2), 0.0),
        "Closest_IO_Tag": of_tag(F.col("closest"), ""), "IO_Pattern_Match": of_tag(F.col("in_family"), False),
    }


def _terminals(x: Column, rule: str | None, scr: str | None) -> tuple[Column, Column]:
    """Terminal texts, and that of the screen: by its own rule without a rule for terminals, else the first of their parts that names it."""
    if rule is None:
        return rules.terminals(x), rules.template(scr, x) if scr else F.lit("")
    parts = F.filter(F.transform(F.split(rules.template(rule, x), ","), lambda p: F.trim(p)), lambda p: F.upper(p).contains("SCR"))
    return rules.terminals(x, rule), F.coalesce(F.get(parts, F.lit(0)), F.lit(""))


def candidates_for_review(inter: DataFrame) -> DataFrame:
    """The rows of the intermediate table that a reviewer looks at: absent tags of a family, and those that the profile recovered."""
    recovered = F.col("Warning").contains(PROFILE)
    of = inter.filter(F.col("Match_Type").isin("similar", "unmatched", "unmatched_candidate") & (F.col("IO_Pattern_Match") | recovered))
    return of.withColumns({"source_type": F.when(recovered, "io_profile_recovery").otherwise("pattern_unmatched_candidate"), "score": F.when(~recovered, F.col("Similarity_Percent") / 100)})


def final_table(io: DataFrame, inter: DataFrame, refs: DataFrame, tag: str = "tag", columns: dict[str, Column] | None = None) -> DataFrame:
    """The I/O list with the intermediate table's columns and JB_SPARE_COUNT, then a row for each spare and for each tag that is absent from
    the list though it is in a family or recovered by the profile, with the list's other columns null.

    A row of the list takes the first intermediate row, by document, page and number, whose tag is the same but for separators; columns of
    both (by name, whatever the case) take its values, and their own where there is none. Rows without a tag stay as they are.

    References are looked up for items, not for rows: an item's first row stands for it, and only rows that may be absent meet the items found.
    inter: the intermediate table, or with columns the rows that these make it from, so that no shuffle before the last holds its texts."""
    inter = stored(inter)  # read in four branches
    t = columns or {c: F.col(c) for c in inter.columns}
    add = [c for c in t if c != ITEM]
    both = {c.lower() for c in io.columns} & {c.lower() for c in add}
    spare = F.coalesce(F.upper(t["Type"]), F.lit("")) == "SPARE"
    order = F.struct(*(t[c].alias(c) for c in ("PDF_Name", "Page", "Tag_Number")), spare.alias("spare"), t[ITEM].alias(ITEM))
    firsts = stored(inter.groupBy(t[ITEM].alias("__item")).agg(F.min_by(F.struct(*inter.columns), order).alias("__row")))
    found = match.exact(firsts.withColumn("tag", F.col("__item")), refs).withColumn("__key", F.coalesce("reference", F.upper(F.trim("__item"))))
    first = found.select("__key", "__row.*").groupBy("__key").agg(F.min_by(F.struct(*inter.columns), order).alias("__row")).select("__key", "__row.*").select("__key", F.struct(*(t[c].alias(c) for c in add)).alias("__first"))
    left = io.withColumn("__key", F.upper(F.trim(F.col(tag)))).join(first, "__key", "left")
    mine = lambda c: F.when(F.col("__first").isNotNull(), F.col("__first")[c]).otherwise(F.col(c)).alias(c) if c.lower() in both else F.col(c)
    new = [c for c in add if c.lower() not in both]
    listed = left.select(*map(mine, io.columns), *(F.col("__first")[c].alias(c) for c in new))

    of_list = match.exact(firsts.select(F.col("__item").alias("tag")), refs).filter("reference is not null").select(F.col("tag").alias("__listed"))
    doubtful = inter.filter(~spare & (F.coalesce(t["IO_Pattern_Match"], F.lit(False)) | F.coalesce(t["Warning"].contains(PROFILE), F.lit(False))))
    absent = inter.filter(spare).unionByName(doubtful.join(of_list.hint("merge"), t[ITEM] == F.col("__listed"), "left_anti")).select(*(c.alias(name) for name, c in t.items()))
    named = inter.filter(spare | F.upper(t[ITEM]).contains("SPARE")).groupBy(F.upper(F.trim(t["JB"])).alias("__box")).agg(F.count("*").alias("JB_SPARE_COUNT"))
    spare, family = F.coalesce(F.upper("Type"), F.lit("")) == "SPARE", F.coalesce("IO_Pattern_Match", F.lit(False))
    keeps = family | (F.col("Match_Type") == "similar")
    known = F.concat(F.when(F.coalesce("Closest_IO_Tag", F.lit("")) == "", "none").otherwise(F.col("Closest_IO_Tag")), F.lit(" ("), _percent(F.coalesce("Similarity_Percent", F.lit(0.0)) / 100), F.lit(")"))
    review = F.when(family, F.concat(F.lit("Not in IO List; closest tag: "), known, F.lit(". Review required. "))).otherwise("Recovered by OCR profile; no IO-family match. Review required. ")
    verdict = {"Warning": F.concat(review, F.coalesce("Warning", F.lit(""))), "Match_Type": F.when(keeps, F.col("Match_Type")).otherwise("unmatched_candidate"),
               "Similarity_Percent": F.when(keeps, F.col("Similarity_Percent")).otherwise(0.0), "Closest_IO_Tag": F.when(keeps, F.col("Closest_IO_Tag")).otherwise("")}
    absent = absent.withColumns({c: F.when(spare, F.col(c)).otherwise(v) for c, v in verdict.items()})
    theirs = lambda c: F.upper(F.trim(ITEM)).alias(c) if c == tag else F.col(c) if c.lower() in both else F.lit(None).cast(io.schema[c].dataType).alias(c)
    every = listed.unionByName(absent.select(*(theirs(c).alias(c) for c in io.columns), *new))
    return every.join(named, F.upper(F.trim("JB")) == F.col("__box"), "left").drop("__box").withColumn("JB_SPARE_COUNT", F.coalesce("JB_SPARE_COUNT", F.lit(0)))


def _listed(values: Column, quote: str = "'") -> Column:
    """An array as a text in brackets."""
    return F.concat(F.lit("[" + quote), F.array_join(values.cast("array<string>"), f"{quote}, {quote}"), F.lit(quote + "]"))


def page_warnings(spans: DataFrame) -> DataFrame:
    """A warning for each page with several boxes, and for each with items but none, with all columns of the report but for order."""
    sets = spans.groupBy("pdf", "page").agg(F.sort_array(F.collect_set(F.when(F.col("kind") == "JB", F.col("token")))).alias("boxes"), F.countDistinct(F.when(F.col("kind") == "Tag", F.col("token"))).alias("tags"), F.count_if(F.col("kind") == "SPARE").alias("spares"))
    page, many = F.col("page").cast("string"), F.size("boxes") > 1
    p = sets.filter(many | ((F.size("boxes") == 0) & (F.col("tags") + F.col("spares") > 0)))
    begin = F.concat(F.lit("Page "), page, F.lit(" of '"), F.col("pdf"), F.lit("' "))
    skipped = F.concat(begin, F.lit("was SKIPPED because multiple JB identifiers were detected: "), _listed(F.col("boxes")), F.lit(". "), F.col("tags").cast("string"), F.lit(" tags on this page were NOT exported."))
    unboxed = F.concat(begin, F.lit("contains "), F.col("tags").cast("string"), F.lit(" tag(s) and "), F.col("spares").cast("string"), F.lit(" spare(s), but NO JB identifier could be detected."))
    kind = F.when(many, "PAGE_SKIPPED_MULTIPLE_JB").otherwise("JB_NOT_FOUND")
    return p.select(
        kind.alias("Warning_Type"), F.when(many, F.array_join("boxes", ",")).otherwise(F.concat(F.lit("JB_NOT_FOUND (page "), page, F.lit(")"))).alias("Item"), F.col("pdf").alias("PDF_Name"), page.alias("Pages"),
        F.when(many, F.col("tags")).otherwise(F.col("tags") + F.col("spares")).alias("Tag_Count"), F.when(many, "ERROR").otherwise("WARNING").alias("Severity"),
        F.when(many, skipped).otherwise(unboxed).alias("Description"), F.when(many, ACTIONS["PAGE_SKIPPED_MULTIPLE_JB"]).otherwise(ACTIONS["JB_NOT_FOUND"]).alias("Action"), F.col("page").alias("__page"),
    )


def cross_warnings(spans: DataFrame) -> DataFrame:
    """Boxes and tags on several pages of a document, and tags in several documents; a warning's text lists them all."""
    s = spans.filter("kind in ('JB', 'Tag')").select("pdf", "page", "kind", F.upper(F.trim("token")).alias("item")).filter("item <> '' and (kind = 'JB' or item not like '%SPARE%')")
    within = s.groupBy("pdf", "kind", "item").agg(F.sort_array(F.collect_set("page")).alias("p")).filter(F.size("p") > 1)
    of = F.when(F.col("kind") == "JB", "JB").otherwise("Tag")
    where = F.concat(of, F.lit(" '"), F.col("item"), F.lit("' appears on "), F.size("p").cast("string"), F.lit(" pages of '"), F.col("pdf"), F.lit("': "), _listed(F.col("p"), ""), F.lit("."))
    action = F.when(F.col("kind") == "JB", ACTIONS["DUPLICATE_JB"]).otherwise(ACTIONS["DUPLICATE_TAG"])
    one = within.select(F.concat(F.lit("DUPLICATE_"), F.upper("kind")).alias("Warning_Type"), F.col("item").alias("Item"), F.col("pdf").alias("PDF_Name"), F.array_join(F.col("p").cast("array<string>"), ", ").alias("Pages"),
                        F.lit(0).cast("bigint").alias("Tag_Count"), F.lit("WARNING").alias("Severity"), where.alias("Description"), action.alias("Action"))
    across = s.filter("kind = 'Tag'").groupBy("item").agg(F.sort_array(F.collect_set("pdf")).alias("p")).filter(F.size("p") > 1)
    text = F.concat(F.lit("Tag '"), F.col("item"), F.lit("' appears in "), F.size("p").cast("string"), F.lit(" different PDFs: "), _listed(F.col("p")), F.lit("."))
    two = across.select(F.lit("DUPLICATE_TAG").alias("Warning_Type"), F.col("item").alias("Item"), F.array_join("p", ",").alias("PDF_Name"), F.array_join("p", ", ").alias("Pages"),
                        F.lit(0).cast("bigint").alias("Tag_Count"), F.lit("INFO").alias("Severity"), text.alias("Description"), F.lit(ACTIONS["ACROSS"]).alias("Action"))
    return one.unionByName(two)


def warnings_report(spans: DataFrame) -> DataFrame:
    """All warnings by severity, type and item: one for each type, item and document without regard to case, the first by class and page;
    a row that says so where there are none."""
    every = page_warnings(spans).withColumn("__class", F.lit(0)).unionByName(cross_warnings(spans).withColumn("__class", F.lit(1)), allowMissingColumns=True)
    keys = [F.upper(F.col(c)).alias(f"__{c}") for c in WARNING_COLUMNS[:3]]
    once = every.groupBy(*keys).agg(F.min_by(F.struct(*WARNING_COLUMNS), F.struct("__class", "__page", "Item", "PDF_Name", "Pages")).alias("w")).select("w.*")
    none = spans.sparkSession.createDataFrame([NO_WARNINGS], once.schema).join(once.limit(1).select(F.lit("NONE").alias("Warning_Type")), "Warning_Type", "left_anti")
    rank = F.when(F.col("Severity") == "ERROR", 0).when(F.col("Severity") == "WARNING", 1).when(F.col("Severity") == "INFO", 2).otherwise(3)
    return once.unionByName(none.select(*once.columns)).orderBy(rank, "Warning_Type", "Item", "PDF_Name")
