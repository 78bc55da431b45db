"""The review loop on rows of runs: positions, shifts, reindexing, patches, issues, logs. Every change maps one snapshot to the next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def reindexed(rows: DataFrame) -> DataFrame:
    """Rows of each box numbered 1..n in order, with terminals 2n - 1, 2n and wires."""
    box = F.upper(F.trim(F.coalesce("jb", F.lit(""))))
    n = F.row_number().over(Window.partitionBy("run_id", box).orderBy("row_index", "id"))
    out = rows.withColumn("number", n)
    pad = F.when(F.col("number") > 99, F.col("number").cast("string")).otherwise(F.lpad(F.col("number").cast("string"), 2, "0"))
    return out.withColumns({"terminal_1": (2 * F.col("number") - 1).cast("string"), "terminal_2": (2 * F.col("number")).cast("string"), "wire_1": F.concat(F.lit("BK"), pad), "wire_2": F.concat(F.lit("WT"), pad)})


def insert_position(rows: DataFrame, nth: int) -> DataFrame:
    """(run_id, jb, at): where a new n-th row of a box goes: the n-th row's place, else after its last."""
    k = F.row_number().over(Window.partitionBy("run_id", "jb").orderBy("row_index", "id"))
    ranked = rows.withColumn("k", k)
    return ranked.groupBy("run_id", "jb").agg(F.coalesce(F.max(F.when(F.col("k") == nth, F.col("row_index"))), F.max("row_index") + 1).alias("at"))


def shifted(rows: DataFrame, at: Column, by: int = 1) -> DataFrame:
    return rows.withColumn("row_index", F.when(F.col("row_index") >= at, F.col("row_index") + by).otherwise(F.col("row_index")))


def inserted(rows: DataFrame, new: DataFrame) -> DataFrame:
    """rows with one new row per run (at its row_index), those from there on moved up by one. Runs without a new row stay."""
    at = new.select("run_id", F.col("row_index").alias("__at"))
    moved = rows.join(at, "run_id", "left").withColumn("row_index", F.when(F.col("row_index") >= F.col("__at"), F.col("row_index") + 1).otherwise(F.col("row_index"))).drop("__at")
    return moved.unionByName(new.select(*rows.columns))


def next_index(rows: DataFrame) -> DataFrame:
    return rows.groupBy("run_id").agg((F.max("row_index") + 1).alias("next_index"))


def unwrapped(outer: Column, inner: Column) -> Column:
    """A flat map from a nested one: inner values win, outer ones fill gaps."""
    return F.map_concat(F.map_filter(outer, lambda k, _: ~F.map_contains_key(inner, k)), inner)


def merged(old: Column, new: Column) -> Column:
    return F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k)), new)


def first_present(m: Column, keys: list[str]) -> Column:
    """The value of the first key that is present, even if it is null."""
    out = F.lit(None)
    for k in reversed(keys):
        out = F.when(F.map_contains_key(m, k), F.try_element_at(m, F.lit(k))).otherwise(out)
    return out


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key: new ones replace old ones."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new.select(*old.columns))


def latest(runs: DataFrame, by: str, created: str, key: str) -> DataFrame:
    return runs.withColumn("__k", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(created), F.desc(key)))).filter("__k = 1").drop("__k")


def log_tail(log: DataFrame, after: int, n: int = 800) -> DataFrame:
    """The log after an id, in order, so many lines: a limit that is the feature."""
    return log.filter(F.col("id") > after).orderBy("id").limit(n)


def severity_rank(c: Column) -> Column:
    return F.when(c == "HIGH", 0).when(c == "MEDIUM", 1).when(c == "LOW", 2).otherwise(3)
