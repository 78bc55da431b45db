"""Reading of many files or pages of which some are broken: a failure becomes a row with its error, and the rest of the job goes on."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from .tables import stored

DONE, FAILED = "done", "failed"


def processed(items: DataFrame, keys: list[str], content: str, read: Callable[[object], Iterable[tuple]], found: StructType) -> DataFrame:
    """keys, status, error and found (an array of structs) of each item, computed once. ``read`` gets an item's content, which may be null,
    and gives rows of ``found``; whatever it raises, and rows that don't fit, fail that item alone and leave its array empty."""
    kept = StructType([items.schema[k] for k in keys])
    out = StructType([*kept.fields, StructField("status", StringType()), StructField("error", StringType()), StructField("found", ArrayType(found))])
    row_type, names = to_arrow_type(ArrayType(found)), found.fieldNames()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            status, errors, rows = [], [], []
            for value in batch.column(len(keys)).to_pylist():
                try:
                    made = [dict(zip(names, r, strict=True)) for r in read(value)]
                    pa.array([made], row_type)  # rows that don't fit fail here
                    status.append(DONE)
                    errors.append(None)
                    rows.append(made)
                except Exception as e:  # any failure belongs to the item
                    status.append(FAILED)
                    errors.append(f"{type(e).__name__}: {e}")
                    rows.append([])
            columns = [*batch.columns[: len(keys)], pa.array(status, pa.string()), pa.array(errors, pa.string()), pa.array(rows, row_type)]
            yield pa.RecordBatch.from_arrays(columns, [*keys, "status", "error", "found"])

    return stored(items.select(*keys, content).mapInArrow(each, out))


def rows_of(done: DataFrame) -> DataFrame:
    """The rows found, with their item's keys."""
    keys = [c for c in done.columns if c not in ("status", "error", "found")]
    return done.select(*keys, F.inline("found"))


def run_statistics(done: DataFrame, by: list[str]) -> DataFrame:
    """For each of ``by``: items, failed ones, rows found, and the first error by name (null without one)."""
    failed = F.col("status") == FAILED
    return done.groupBy(*by).agg(F.count("*").alias("items"), F.count_if(failed).alias("failed"), F.sum(F.size("found")).alias("found"), F.min(F.when(failed, F.col("error"))).alias("first_error"))
