"""Workbooks and other files as tables. Files are read by Spark's own readers, so any store that Spark reaches will do."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", ref)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def sheets(content: bytes) -> Iterator[tuple[str, int, list[str | None]]]:
    """(sheet, row from 0, cells as text) of a workbook, row by row; gaps are null."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{_MAIN}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")]
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"):
            target = targets[sheet.get(f"{_REL}id")].lstrip("/")
            part = target if target.startswith("xl/") else f"xl/{target}"
            for row in ElementTree.fromstring(z.read(part)).iter(f"{_MAIN}row"):
                cells: list[str | None] = []
                for c in row.iter(f"{_MAIN}c"):
                    at = _column(c.get("r"))
                    cells += [None] * (at + 1 - len(cells))
                    v = c.find(f"{_MAIN}v")
                    if c.get("t") == "inlineStr":
                        cells[at] = "".join(t.text or "" for t in c.iter(f"{_MAIN}t"))
                    elif v is not None:
                        cells[at] = shared[int(v.text)] if c.get("t") == "s" else v.text
                yield sheet.get("name"), int(row.get("r")) - 1, cells


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("file", pa.string()), ("sheet", pa.string()), ("row", pa.int32()), ("cells", pa.list_(pa.string())), ("error", pa.string())])
    for batch in batches:
        for path, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            try:
                rows = [(path, s, r, c, None) for s, r, c in sheets(content)]
            except Exception as e:  # one bad file doesn't end the run; it gives a row that says why
                rows = [(path, None, None, None, f"{type(e).__name__}: {e}")]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True) if rows else [()] * 5, schema, strict=True)], schema=schema)


def workbook_rows(spark: SparkSession, path: str) -> DataFrame:
    """(file, sheet, row, cells, error) of all workbooks under a path."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_parsed, "file string, sheet string, row int, cells array<string>, error string")


def hashed_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def new_files(files: DataFrame, known: DataFrame, keys: tuple[str, ...] = ("project", "kind", "sha256")) -> DataFrame:
    """Uploads that the store does not have yet, each once."""
    return files.dropDuplicates(list(keys)).join(known.select(*keys), list(keys), "left_anti")


def ingested(rows: DataFrame, order: list[Column], columns: dict[str, list[str]]) -> DataFrame:
    """Rows of a list with 1-based row_index, each logical column from the first of its spellings that is not blank, and the raw row as JSON."""
    have = {c.upper(): c for c in rows.columns}
    pick = lambda names: X.first_of(*(F.col(f"`{have[n.upper()]}`") for n in names if n.upper() in have)) if any(n.upper() in have for n in names) else F.lit(None).cast("string")
    return rows.select(F.row_number().over(Window.partitionBy("run_id").orderBy(*order)).alias("row_index"), "run_id", *(pick(v).alias(k) for k, v in columns.items()), F.to_json(F.struct("*")).alias("raw_json"))


def sample_indices(n: Column, k: int) -> Column:
    """Pages looked at to tell a document's type: first, middle, last and evenly spaced ones, sorted, the first k."""
    spaced = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.floor(i * n / k).cast("bigint"))
    ends = F.array(F.lit(0).cast("bigint"), F.floor(n / 2).cast("bigint"), (n - 1).cast("bigint"))
    return F.slice(F.array_sort(F.array_distinct(F.concat(ends, spaced))), 1, k)


def effective_dpi(pages: Column) -> Column:
    return F.when(pages > 300, 150).when(pages > 100, 200).otherwise(300)


def page_type(chars: Column, hidden_share: Column, image_share: Column) -> Column:
    return F.when(chars < 1, "scanned").when((image_share >= 0.8) & (hidden_share >= 0.8), "scanned").when(chars >= 30, "digital").otherwise("scanned")


def document_type(pages: DataFrame) -> DataFrame:
    """Majority of the sampled pages; digital only if strictly more. pages: pdf, page_type."""
    return pages.groupBy("pdf").agg(F.when(F.count_if(F.col("page_type") == "digital") > F.count_if(F.col("page_type") == "scanned"), "digital").otherwise("scanned").alias("pdf_type"))


def shifted_font(c: Column, by: int = 29) -> Column:
    """Decode text of a font whose codes up to 97 lie too low by a fixed step."""
    low = "".join(map(chr, range(1, 98)))
    return F.translate(c, low, "".join(chr(ord(x) + by) for x in low))


def native_spans(pages: DataFrame, dpi: int = 300) -> DataFrame:
    """Spans from pages of blocks of lines of spans with boxes in points; pixels, whole numbers, reading order."""
    s = pages.select("pdf", "page", F.explode("blocks").alias("b")).select("pdf", "page", F.explode("b.lines").alias("l")).select("pdf", "page", F.explode("l.spans").alias("s"))
    px = lambda c: F.bround(c * dpi / 72).cast("int")
    box = s.select("pdf", "page", "s.text", px(F.col("s.x0")).alias("x"), px(F.col("s.y0")).alias("y"), F.greatest(F.lit(1), px(F.col("s.x1") - F.col("s.x0"))).alias("w"), F.greatest(F.lit(1), px(F.col("s.y1") - F.col("s.y0"))).alias("h"), F.lit(1.0).alias("confidence"))
    return box.filter(F.length(F.trim("text")) > 0).withColumn("seq", F.row_number().over(Window.partitionBy("pdf", "page").orderBy("y", "x", "text")))


def native_or_ocr(native: DataFrame, ocr: DataFrame) -> DataFrame:
    """Pages whose native spans hold any identifier keep them; all others take the recognised ones."""
    good = native.filter("kind <> 'Unknown'").select("pdf", "page").distinct()
    return native.join(good, ["pdf", "page"], "left_semi").unionByName(ocr.join(good, ["pdf", "page"], "left_anti"))


def recovered(spans: DataFrame, alternate: DataFrame) -> DataFrame:
    """Pages without a box get the boxes, and nothing else, of an alternate reading."""
    boxed = spans.filter("kind = 'JB'").select("pdf", "page").distinct()
    return spans.unionByName(alternate.filter("kind = 'JB'").join(boxed, ["pdf", "page"], "left_anti"))
