"""Cleaning of an I/O list: normal spellings, rejected rows, imputed locations, ranks and the report of it all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


def once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """df with columns, of new names, that are computed once a row: a generator of one row. A plain projection would be put, expressions and
    all, in place of each later use, which doubles with every step, and into the filters below the joins."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def normalised(io: DataFrame) -> DataFrame:
    """Every row with its normal io, safety and location, ranks, and the reason why it is rejected (null if it stays)."""
    texts = [n for n, t in io.dtypes if t == "string"]
    c = once(io.select(*(F.col(n).alias(f"__{n}") if n in texts else F.col(n) for n in io.columns)), {n: X.cleaned(F.col(f"__{n}")) for n in texts})
    c = once(c.select(*io.columns), {"io_key": X.io_key(F.col("io_type")), "safety_raw": F.col("safety"), "location_raw": F.col("location")})
    found = {"io": X.lookup(F.col("io_key"), X.IO_NORMAL), "safety": X.lookup(F.col("safety_raw"), X.SAFETY_NORMAL), "known_location": X.lookup(F.col("location_raw"), X.LOCATION_NORMAL)}
    c = once(c.drop("safety", "location"), found)
    reason = (
        F.when((F.col("jb") == "") | (F.col("io_type") == ""), "missing")
        .when(F.col("jb").isin(X.INVALID_JB), "invalid_jb")
        .when(F.col("io").isNull(), "invalid_io")
        .when(F.col("safety").isNull(), "invalid_safety")
    )
    c = once(c, {"location": F.coalesce("known_location", F.lit("FIELD")), "imputed": F.col("known_location").isNull(), "rejected": reason})
    rank = lambda n, table: F.coalesce(X.lookup(F.col(n), table), F.lit(99))
    c = once(c, {"rank_io": rank("io", X.RANK_IO), "rank_safety": rank("safety", X.RANK_SAFETY), "rank_location": rank("location", X.RANK_LOCATION)})
    return c.select(*io.columns, "io_key", "safety_raw", "location_raw", "io", "imputed", "rejected", "rank_io", "rank_safety", "rank_location", F.lit("ACTIVE").alias("signal_type"))


def clean(io: DataFrame) -> DataFrame:
    return normalised(io).filter("rejected is null")


def report(io: DataFrame) -> DataFrame:
    """(section, n): how many rows each section of the cleaning report holds, in one pass over the list."""
    n = normalised(io)
    stays, rejected = F.col("rejected").isNull(), F.col("rejected")
    count = lambda cond: F.count_if(cond)
    sections = {
        "total_raw": F.count("*"),
        "total_clean": count(stays),
        "removed": count(~stays),
        "removed_missing_critical": count(rejected == "missing"),
        "removed_invalid_jb": count(rejected == "invalid_jb"),
        "invalid_io": count(rejected == "invalid_io"),
        # rows whose safety was rewritten or is unknown; the unknown ones are dropped, and still reported
        "safety_conversion": count((stays | (rejected == "invalid_safety")) & ~F.col("safety_raw").eqNullSafe(F.col("safety"))),
        "location_imputed": count(stays & F.col("imputed")),
        "logical_exceptions": count(stays & F.col("io").isin("AI", "AO") & (F.col("location") == "MCC")),
    }
    one = n.agg(*(F.coalesce(v, F.lit(0)).alias(k) for k, v in sections.items()))
    return one.select(F.inline(F.array(*(F.struct(F.lit(k).alias("section"), F.col(k).alias("n")) for k in sections))))


def spare_count(c: str) -> Column:
    """A spare count from any text: not a number or negative counts as 0."""
    return F.greatest(F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)), F.lit(0.0))


MASTER_ORDER = ("rank_io", "rank_safety", "rank_location", "jb", "seq")
