"""Consolidation of workbooks: column names, data rows, full outer merge with conflicts, fill rates."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Names under which a workbook may hold a logical column, in order of priority; words that mark a row as no data; names of
# sheets without data; what a tag looks like where columns have no known names.
ALIASES = {
    "tag": ["Tag No", "Tag No.", "Tag no", "Tag no.", "tag no", "tag no.", "TAG NO", "TAG NO.", "Tag", "TAG", "tag", "TAG.", "Tag Number", "Tag_Number", "TAG NUMBER", "tag number", "TagNo", "TAGNO", "tagno", "تگ", "شماره تگ"],
    "loop": ["Loop No", "Loop No.", "Loop no", "loop no", "LOOP NO", "Loop", "LOOP", "loop", "Loop Number", "Loop_No", "loop_number", "LOOP NUMBER", "لوپ", "شماره لوپ"],
    "jb": ["JB", "J.B", "J B", "jb", "JB No", "JB No.", "JB no", "JB NO", "Junction Box", "JUNCTION BOX", "junction box", "JB_ID", "JBID", "J/B", "JunctionBox"],
    "io_type": ["I/O Type", "IO Type", "IOType", "I O Type", "i/o type", "io type", "IO TYPE", "I/O TYPE", "Signal Type", "SIGNAL TYPE", "signal type", "IOType", "I/O_Type", "نوع IO", "نوع سیگنال", "نوع ورودی/خروجی"],
    "safety": ["IS/NIS", "IS-NIS", "IS_NIS", "IS/NIS.", "is/nis", "IS/NIS ", " IS/NIS", "Safety", "SAFETY", "safety", "Safe", "SAFE", "safe", "SIL", "Sil", "sil", "Instrumented", "INSTRUMENTED", "ایمن", "غیرایمن", "IS/ NIS", "IS / NIS"],
    "location": ["Location", "LOCATION", "location", "Loc", "LOC", "loc", "Area", "AREA", "area", "Place", "PLACE", "محل", "مکان", "ناحیه"],
    "terminal_1": ["terminal-1", "Terminal-1", "TERMINAL-1", "terminal1", "Terminal1", "TERMINAL1", "terminal 1", "Terminal 1", "TERMINAL 1", "term1", "Term1", "TERM1", "terminal_1", "Terminal_1", "t1", "T1", "ترمینال ۱", "ترمینال 1"],
    "terminal_2": ["terminal-2", "Terminal-2", "TERMINAL-2", "terminal2", "Terminal2", "TERMINAL2", "terminal 2", "Terminal 2", "TERMINAL 2", "term2", "Term2", "TERM2", "terminal_2", "Terminal_2", "t2", "T2", "ترمینال ۲", "ترمینال 2"],
    "src": ["SRC", "src", "Src", "Source", "SOURCE", "source", "SRC.", "src.", "منبع"],
    "cable": ["Cable Description", "Cable_Description", "cable description", "CABLE DESCRIPTION", "Cable Desc", "CableDesc", "Cable Code", "CableCode", "Cable", "CABLE", "cable", "کابل", "توضیح کابل"],
    "description": ["Description", "DESCRIPTION", "description", "Desc", "DESC", "Remark", "Remarks", "REMARKS", "توضیحات", "یادداشت"],
    "instrument": ["Instrument", "INSTRUMENT", "instrument", "Device", "DEVICE", "Equipment", "EQUIPMENT", "تجهیز", "دستگاه"],
    "service": ["Service", "SERVICE", "service", "Function", "FUNCTION", "Process", "PROCESS", "سرویس", "فرآیند"],
}
SKIP_WORDS = [
    "project", "total", "sum", "average", "count", "note:", "remark:", "page", "sheet", "revision", "date:", "approved", "checked",
    "پروژه", "جمع", "مجموع", "تعداد", "توضیح", "صفحه", "بازبینی", "تأیید", "بررسی شده", "نسخه",
]
SKIP_SHEETS = [
    "cover", "title", "index", "contents", "summary", "report", "info", "information", "about", "readme", "note", "notes",
    "کاور", "عنوان", "فهرست", "خلاصه", "گزارش", "اطلاعات",
    "jb list", "jblist", "jb_list", "list of jb", "jb-list", "cabinet list", "cabinet", "layout", "drawing",
]
TAG_LIKE = "(?i)^[A-Z]{1,5}-?[0-9]{2,5}[A-Z]?$"
BLANK = ["", "NAN", "NONE", "-", "N/A"]


def _norm(name: str) -> str:
    return re.sub(r"[ _./-]", "", name.strip().lower())


def resolve_columns(columns: list[str], aliases: dict[str, list[str]] | None = None) -> dict[str, str]:
    """Logical name -> column, by five tests from strict to loose; no column serves twice."""
    plain = lambda x: x.strip().lower()
    tests = (
        lambda c, a: c == a,
        lambda c, a: plain(c) == plain(a),
        lambda c, a: _norm(c) == _norm(a),
        lambda c, a: len(a) >= 4 and (plain(c).startswith(plain(a)) or plain(a).startswith(plain(c))),
        lambda c, a: len(a) >= 5 and (plain(a) in plain(c) or plain(c) in plain(a)),
    )
    out: dict[str, str] = {}
    for key, names in (aliases or ALIASES).items():
        free = [c for c in columns if c not in out.values()]
        found = next((c for t in tests for a in names for c in free if t(c, a)), None)
        if found is not None:
            out[key] = found
    return out


def data_sheets(cells: DataFrame, within: int = 20) -> DataFrame:
    """(file, sheet, place): the sheets that hold data, in order of place. A sheet does if its name holds no word of SKIP_SHEETS, it has a
    header and at least three rows under it, two columns, and a column named as tags are or with three values among its first that look
    like tags. cells: file, sheet, place, row (0: the header), cells array."""
    named = F.exists(F.array(*map(F.lit, SKIP_SHEETS)), lambda w: F.lower(F.trim("sheet")).contains(w))
    tags = sorted({_norm(a) for a in ALIASES["tag"]})
    header = F.col("row") == 0
    titles = F.transform("cells", lambda c: F.regexp_replace(F.lower(F.trim(c)), "[ _./-]", ""))
    per = cells.groupBy("file", "sheet", "place").agg(F.count_if(~header).alias("n"), F.max(F.size("cells")).alias("width"), F.coalesce(F.bool_or(header & F.arrays_overlap(titles, F.array(*map(F.lit, tags)))), F.lit(False)).alias("tag_column"))
    values = cells.filter(~header & (F.col("row") <= within)).select("file", "sheet", F.posexplode("cells").alias("column", "value")).filter(F.trim("value").rlike(TAG_LIKE))
    like = values.groupBy("file", "sheet", "column").count().filter("count >= 3").select("file", "sheet").distinct().withColumn("like", F.lit(True))
    return per.filter(~named & (F.col("n") >= 3) & (F.col("width") >= 2)).join(like, ["file", "sheet"], "left").filter(F.col("tag_column") | F.col("like")).select("file", "sheet", "place")


def first_sheets(cells: DataFrame) -> DataFrame:
    """(file, sheet): of each file the first sheet that holds data."""
    return data_sheets(cells).groupBy("file").agg(F.min_by("sheet", "place").alias("sheet"))


def standardised(df: DataFrame, aliases: dict[str, list[str]] | None = None) -> DataFrame:
    return df.withColumnsRenamed({c: k for k, c in resolve_columns(df.columns, aliases).items()})


def header_row(cells: DataFrame, aliases: dict[str, list[str]] | None = None, within: int = 10) -> DataFrame:
    """(file, sheet, header): the first of the first rows that holds two known names, else 0. cells: file, sheet, row, cells array."""
    known = sorted({_norm(a) for names in (aliases or ALIASES).values() for a in names})
    hits = F.size(F.filter("cells", lambda c: F.regexp_replace(F.lower(F.trim(c)), "[ _./-]", "").isin(known)))
    return cells.filter(F.col("row") < within).groupBy("file", "sheet").agg(F.coalesce(F.min(F.when(hits >= 2, F.col("row"))), F.lit(0)).alias("header"))


def likely_tag(tag: Column) -> Column:
    """Up to 30 characters, no inner space unless it looks like a tag, and not more than ten of letters alone (points and dashes aside)."""
    letters = F.regexp_replace(tag, "[._-]", "").rlike(r"^\p{L}+$")
    return (F.length(tag) <= 30) & (~tag.contains(" ") | tag.rlike(TAG_LIKE)) & ~(letters & (F.length(tag) > 10))


def data_rows(df: DataFrame, tag: str = "tag", skip: list[str] | None = None) -> DataFrame:
    t = F.trim(F.coalesce(F.col(tag), F.lit("")))
    words = "|".join(map(re.escape, skip or SKIP_WORDS))
    return df.withColumn(tag, t).filter(~F.upper(tag).isin(BLANK) & ~F.lower(tag).rlike(words) & likely_tag(F.col(tag))).withColumn(tag, F.upper(tag))


def _merged(left: DataFrame, right: DataFrame) -> DataFrame:
    shared = [c for c in left.columns if c in right.columns and c != "tag"]
    r = right.select("tag", *(F.col(c).alias(f"__r_{c}") if c in shared else F.col(c) for c in right.columns if c != "tag"))
    j = left.join(r, "tag", "full")
    return j.select("tag", *(F.coalesce(c, f"__r_{c}").alias(c) if c in shared else F.col(c) for c in [*left.columns[1:], *(c for c in right.columns if c not in left.columns)]))


def merge(inputs: list[DataFrame]) -> DataFrame:
    """Full outer merge on tag, folded in order; the first value that is not null stays. Each input has its tag first and once."""
    return reduce(_merged, inputs)


def conflicts(left: DataFrame, right: DataFrame, most: int = 5) -> DataFrame:
    """(column, tag, kept, other): where both sides differ, the first few by tag for each column."""
    shared = [c for c in left.columns if c in right.columns and c != "tag"]
    pairs = left.select("tag", *(F.col(c).alias(f"l_{c}") for c in shared)).join(right.select("tag", *(F.col(c).alias(f"r_{c}") for c in shared)), "tag")
    rows = pairs.select("tag", F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"l_{c}").cast("string").alias("kept"), F.col(f"r_{c}").cast("string").alias("other")) for c in shared))))
    rank = F.row_number().over(Window.partitionBy("column").orderBy("tag"))
    return rows.filter("kept <> other").withColumn("k", rank).filter(F.col("k") <= most).drop("k")


def fill_rates(df: DataFrame) -> DataFrame:
    """(column, filled, total) of every column, in one pass."""
    one = df.agg(F.count("*").alias("__n"), *(F.count(c).alias(c) for c in df.columns))
    return one.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("filled"), F.col("__n").alias("total")) for c in df.columns))))


def deduplicated(df: DataFrame, order: list[str]) -> DataFrame:
    return df.withColumn("__k", F.row_number().over(Window.partitionBy("tag").orderBy(*order))).filter("__k = 1").drop("__k")
