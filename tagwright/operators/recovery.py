"""Tags that no literal family of the references holds: candidates by the references' profile, and readings with confused characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

# Shapes of tags, the general shape, tokens of a text, prefixes where the references have none, points and the least score.
SHAPES = [
    "[A-Z]{2,6}-[0-9]{1,5}(?:-[A-Z0-9]{1,5})?", "[A-Z]{2,6}[0-9]{2,5}(?:[A-Z]{0,2})?", "[A-Z]{2,6}-[A-Z0-9]{2,8}(?:-[A-Z0-9]{1,5})?",
    "[0-9]{1,4}[A-Z]{1,6}-?[0-9]{1,5}(?:[A-Z]{0,3})?(?:-[A-Z0-9]{1,5})?", "[0-9]{1,4}[A-Z]{2,6}[0-9]{2,5}(?:[A-Z]{1,4})?",
    "[0-9]{1,4}[A-Z]{2,6}[0-9]{1,4}[A-Z]{2,6}[0-9]{1,4}[A-Z]{2,6}[0-9]{1,4}", "[0-9]{1,4}[A-Z]{2,6}[0-9]{1,4}[A-Z]{2,6}[0-9]{1,4}[A-Z]{0,2}[A-Z]{2,6}[0-9]{1,4}",
    "[0-9]{1,4}[A-Z]{2,8}(?:[0-9]{1,4}[A-Z]{0,8}){1,4}(?:[0-9]{1,4})?(?:-[A-Z0-9]{1,8}){0,2}", "[0-9]{1,4}[A-Z]{2,10}-[A-Z]{0,4}[0-9]{1,4}-?[0-9]{0,4}",
    "[0-9]{1,4}[A-Z]{2,10}-[0-9]{1,4}-[A-Z]{0,4}[0-9]{0,4}", "[0-9]{1,4}-[A-Z]{2,6}-[0-9]{1,5}[A-Z]?", "[0-9]{1,4}-[A-Z]{2,6}-[0-9]{1,5}-[A-Z0-9]{1,5}",
]
GENERAL = "[A-Z0-9]{2,6}-?[A-Z0-9]{1,10}(?:-[A-Z0-9]{1,10}){0,3}"
TOKEN = "(?i)(?<![A-Z0-9])[A-Z0-9]+(?:[-_][A-Z0-9]+){0,3}(?![A-Z0-9])"
DEFAULT_PREFIXES = ["UZSO", "UZSC", "FIT", "PIT", "TIT", "LIT", "FCV", "PCV", "TCV", "LCV", "TY", "LA", "UY", "UHSL", "UHSH"]
BASE, KNOWN, CLOSE, LENGTH, DIGITS, HYPHEN, LEAST = 0.35, 0.35, 0.22, 0.15, 0.1, 0.1, 0.62
#: Characters that are read for one another: a digit and its letters, in the order in which they are tried for it.
CONFUSED = {"0": "ODQU", "1": "I", "5": "S", "8": "B", "2": "Z", "6": "G"}


def _fits(c: Column, pattern: str) -> Column:
    return c.rlike(f"^(?:{pattern})$")


def prefixes(refs: DataFrame) -> DataFrame:
    """(prefix, after_area): the letters, or the area number and letters, that references begin with. after_area: no reference begins with
    the letters themselves, so they count behind an area number alone (letters of up to four)."""
    tag = X.canonical_tag(F.col("reference"))
    t = refs.select(tag.alias("t")).filter("t <> ''")
    forms = ["^([A-Z]{2,6})", "^([0-9]{1,4}[A-Z]{1,6})", "^[0-9]{1,4}-([A-Z]{1,6})"]
    each = t.select(F.explode(F.array(*(F.regexp_extract("t", p, 1) for p in forms))).alias("prefix")).filter("prefix <> ''").distinct()
    # A reference that begins with letters begins with each shorter run of them.
    starts = t.select(F.explode(F.sequence(F.lit(1), F.least(F.lit(6), F.length(F.regexp_extract("t", "^[A-Z]*", 0))))).alias("k"), "t").filter("k > 0").select(F.expr("left(t, k)").alias("prefix")).distinct()
    known = each.join(starts.withColumn("starts", F.lit(True)), "prefix", "left")
    letters = F.col("prefix").rlike("^[A-Z]+$")
    return known.select("prefix", (letters & F.col("starts").isNull() & (F.length("prefix") <= 4)).alias("after_area"))


def profile(refs: DataFrame) -> DataFrame:
    """One row: shortest, longest, mean_run (of digits), hyphens (share of tags with one) of the normalised references, and some (whether a
    reference gives a prefix)."""
    t = refs.select(X.canonical_tag(F.col("reference")).alias("t")).filter("t <> ''").withColumn("runs", F.regexp_extract_all("t", F.lit("[0-9]+"), F.lit(0)))
    digits = F.sum(F.aggregate("runs", F.lit(0), lambda a, x: a + F.length(x)))
    mean = F.when(F.sum(F.size("runs")) > 0, digits / F.sum(F.size("runs"))).otherwise(3.0)
    one = t.agg(F.coalesce(F.min(F.length("t")), F.lit(5)).alias("shortest"), F.coalesce(F.max(F.length("t")), F.lit(16)).alias("longest"), F.coalesce(mean, F.lit(3.0)).alias("mean_run"),
                F.coalesce(F.avg(F.col("t").contains("-").cast("int")), F.lit(0.5)).alias("hyphens"), F.coalesce(F.bool_or(F.col("t").rlike("^[A-Z]{2}|^[0-9]{1,4}-?[A-Z]")), F.lit(False)).alias("some"))
    return one


def profile_prefixes(refs: DataFrame) -> DataFrame:
    """The distinct prefixes that candidates are scored by: letters that a reference begins with, else those after its area number."""
    t = refs.select(X.canonical_tag(F.col("reference")).alias("t")).filter("t <> ''")
    letters, attached, dashed = (F.regexp_extract("t", p, 1) for p in ("^([A-Z]{2,6})", "^[0-9]{1,4}([A-Z]{1,6})", "^[0-9]{1,4}-([A-Z]{1,6})"))
    found = t.select(F.explode(F.when(letters != "", F.array(letters)).otherwise(F.array(attached, dashed))).alias("ref_prefix")).filter("ref_prefix <> ''").distinct()
    default = refs.sparkSession.createDataFrame([(p,) for p in DEFAULT_PREFIXES], "ref_prefix string")
    return found.unionByName(default.join(found.limit(1).select(F.lit(1).alias("one")), F.lit(True), "left_anti"))


def deletions(c: Column) -> Column:
    """The text and all that come from it by leaving out one character: two texts within one edit have one of these in common."""
    cut = F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, F.length(c))))
    return F.when(F.length(c) > 0, F.array_distinct(F.concat(F.array(c), cut))).otherwise(F.array(c))


def within_one_edit(left: DataFrame, right: DataFrame, a: str, b: str) -> DataFrame:
    """The distinct (a, b) that are at most one insertion, deletion or substitution apart, by an equi-join on deletions."""
    l = left.select(a).distinct().select(a, F.explode(deletions(F.col(a))).alias("part"))  # noqa: E741
    r = right.select(b).distinct().select(b, F.explode(deletions(F.col(b))).alias("part"))
    return l.join(r, "part").select(a, b).distinct().filter(F.levenshtein(a, b) <= 1)


def scored(tags: DataFrame, refs: DataFrame) -> DataFrame:
    """tags (column tag, normalised) with score: 0 without a tag's shape, else points for a known or close prefix, length, digits, hyphens."""
    t = F.col("tag")
    area = F.regexp_extract(t, "^[0-9]{1,4}-([A-Z]{1,6})[-0-9]", 1)
    shaped = (F.length(t) >= 4) & t.rlike("[A-Z]") & t.rlike("[0-9]") & _fits(t, "|".join(SHAPES))
    own = tags.select("tag").distinct().withColumns({"shaped": shaped, "prefix": F.when(area != "", area).otherwise(F.regexp_extract(t, "^([A-Z0-9]+)", 1))})
    known = profile_prefixes(refs)
    near = within_one_edit(own.filter("shaped"), known, "prefix", "ref_prefix").groupBy("prefix").agg(F.max(F.when(F.col("prefix") == F.col("ref_prefix"), KNOWN).otherwise(CLOSE)).alias("by_prefix"))
    p = own.join(near, "prefix", "left").crossJoin(F.broadcast(profile(refs)))  # the profile is one row
    run = F.length(F.regexp_extract(t, "[0-9]+", 0))
    by_digits = DIGITS * F.greatest(F.lit(0.0), 1 - F.abs(run - F.col("mean_run")) / F.greatest(F.col("mean_run"), F.lit(1.0)))
    score = (
        BASE + F.coalesce("by_prefix", F.lit(0.0)) + F.when(F.length(t).between(F.col("shortest") - 2, F.col("longest") + 2), LENGTH).otherwise(0.0)
        + by_digits + F.when((F.col("hyphens") >= 0.5) == t.contains("-"), HYPHEN).otherwise(0.0)
    )
    return tags.join(p.select("tag", F.when(F.col("shaped"), F.least(F.lit(1.0), score)).otherwise(0.0).alias("score")), "tag")


def candidates(texts: DataFrame, refs: DataFrame, column: str = "text") -> DataFrame:
    """(text, tag, score): tokens of each distinct text that score enough, or have the general shape and begin as references do. They are
    for review; none is taken for a reference."""
    tokens = F.transform(F.regexp_extract_all(F.col(column), F.lit(TOKEN), F.lit(0)), lambda x: X.canonical_tag(F.btrim(x, F.lit("-_"))))
    t = F.col("tag")
    each = texts.select(column).filter(F.col(column).isNotNull()).distinct().select(column, F.explode(F.array_distinct(tokens)).alias("tag")).filter((F.length(t) >= 4) & t.rlike("[A-Z]") & t.rlike("[0-9]"))
    found = scored(each.select("tag").distinct(), refs)
    begins = found.select("tag", F.explode(F.array(
        F.struct(F.regexp_extract(t, "^([A-Z]+|[0-9]+[A-Z]+)[-0-9]", 1).alias("prefix"), F.lit(False).alias("after_area")),
        F.struct(F.regexp_extract(t, "^[0-9]{1,4}-([A-Z]+)[-0-9]", 1).alias("prefix"), F.lit(True).alias("after_area")),
    )).alias("b")).select("tag", "b.*")
    learned = begins.join(prefixes(refs), ["prefix", "after_area"], "left_semi").select("tag").distinct().withColumn("learned", F.lit(True))
    accepted = (F.col("score") >= LEAST) | (_fits(t, GENERAL) & F.coalesce("learned", F.lit(False)))
    return each.join(found.join(learned, "tag", "left").filter(accepted).select("tag", "score"), "tag").select(column, "tag", "score")


def confusion_key(c: Column) -> Column:
    """The text with each letter that a digit is confused with replaced by the digit."""
    letters = "".join(CONFUSED.values())
    return F.translate(c, letters, "".join(d * len(of) for d, of in CONFUSED.items()))


def corrected(tags: DataFrame, refs: DataFrame) -> DataFrame:
    """(tag, corrected): upper case and trimmed; a tag that is no reference becomes the one that differs in one, else two characters, each
    a digit where the other has a letter confused with it. The first place that differs decides between several, then the order in which
    the characters are tried. Nothing is spelled out: such pairs agree in their confusion key, so one equi-join finds them all."""
    t, r = F.col("t"), F.col("reference")
    own = tags.select("tag").distinct().withColumn("t", F.upper(F.trim("tag")))
    known = refs.select("reference").distinct()
    rest = own.join(known, t == r, "left_anti").filter("t is not null and t <> ''").withColumn("key", confusion_key(t))
    met = rest.join(known.withColumn("key", confusion_key(r)), "key")
    order = {new: k for of in CONFUSED.values() for k, new in enumerate(of)}
    tried = lambda c: F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in order.items() for x in kv)), c), F.lit(0))
    at = F.filter(F.sequence(F.lit(1), F.length(t)), lambda i: F.substring(t, i, F.lit(1)) != F.substring(r, i, F.lit(1)))
    met = met.withColumn("at", at).filter(F.size("at").between(1, 2))
    swaps = met.withColumn("swaps", F.transform("at", lambda i: F.struct(i.alias("place"), tried(F.substring(r, i, F.lit(1))).alias("order"), (F.substring(t, i, F.lit(1)).rlike("[0-9]") != F.substring(r, i, F.lit(1)).rlike("[0-9]")).alias("direct"))))
    direct = swaps.filter(F.forall("swaps", lambda s: s["direct"])).withColumn("rank", F.struct(F.size("swaps").alias("n"), F.transform("swaps", lambda s: F.struct(s["place"], s["order"])).alias("s")))
    best = direct.groupBy("tag").agg(F.min_by("reference", "rank").alias("best"))
    return own.join(best, "tag", "left").select("tag", F.coalesce("best", "t").alias("corrected"))
