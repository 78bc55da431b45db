"""Fonts whose texts come out of a document shifted: statistics by font decide, and only the spans of such fonts are decoded.

spans: pdf, page, font, text and anything else. A null font is a font of its own, a null text is empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workbooks import shifted_font

# The least text that says something, control characters in it by number and share, and the share that must be printable
# once decoded.
LEAST_CHARS, LEAST_CONTROLS, CONTROL_SHARE, PRINTABLE_SHARE = 20, 3, 0.10, 0.95


def font_statistics(spans: DataFrame) -> DataFrame:
    """(pdf, page, font, chars, controls, printable, shifted) of each font of a page; printable counts the decoded text."""
    text = F.coalesce("text", F.lit(""))
    without = lambda c, kind: F.length(c) - F.length(F.regexp_replace(c, kind, ""))
    of = spans.select("pdf", "page", "font", F.length(text).alias("n"), without(text, "[\\x00-\\x1f]").alias("c"), without(shifted_font(text), r"[^\p{C}\p{Z}]| ").alias("p"))
    stats = of.groupBy("pdf", "page", "font").agg(F.sum("n").alias("chars"), F.sum("c").alias("controls"), F.sum("p").alias("printable"))
    n = F.col("chars")
    shifted = (n >= LEAST_CHARS) & (F.col("controls") >= LEAST_CONTROLS) & (F.col("controls") >= CONTROL_SHARE * n) & (F.col("printable") > PRINTABLE_SHARE * n)
    return stats.withColumn("shifted", shifted)


def repaired(spans: DataFrame) -> DataFrame:
    """spans with the texts of shifted fonts decoded, all without outer white space, and none that is blank."""
    s = font_statistics(spans).filter("shifted").select(F.col("pdf").alias("s_pdf"), F.col("page").alias("s_page"), F.col("font").alias("s_font"), F.col("shifted").alias("s_shifted"))
    same = (F.col("pdf") == F.col("s_pdf")) & (F.col("page") == F.col("s_page")) & F.col("font").eqNullSafe(F.col("s_font"))
    text = F.when(F.col("s_shifted"), shifted_font(F.col("text"))).otherwise(F.col("text"))
    out = spans.join(s, same, "left").withColumn("text", F.regexp_replace(text, r"^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")).filter("text <> ''")
    return out.select(*spans.columns)
