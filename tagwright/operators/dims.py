"""Capacities of cabinets from their dimensions in millimetres, and the way back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Heights of boards.
HEIGHTS = {
    "Barrier Board (AI)": 75.0, "Barrier Board (AO)": 75.0, "Barrier Board (DI)": 45.0, "Barrier Board (DO)": 45.0,
    "Terminal Board (AI)": 60.0, "Terminal Board (AO)": 60.0, "Terminal Board (DI)": 45.0, "Terminal Board (DO)": 45.0,
    "Relay Board AI capacity": 90.0, "Relay Board AO capacity": 90.0, "Relay Board DI capacity": 90.0, "Relay Board DO capacity": 90.0,
}
UNKNOWN_SHARE, NO_ROOM = 14.3, 100.0


def heights(spark: SparkSession, table: dict[str, float] | None = None) -> DataFrame:
    return spark.createDataFrame(list((table or HEIGHTS).items()), "board string, height double")


def rail_terminals(length: Column, top: Column, bottom: Column, height: Column, rails: Column) -> Column:
    usable = length - top - bottom
    return F.when((usable <= 0) | (height <= 0), F.lit(0)).otherwise(F.greatest(F.floor(usable / height) * rails, F.lit(0))).cast("bigint")


def cards(usable: Column, height: Column, gap: Column, columns: Column) -> Column:
    return F.when((usable > 0) & (height + gap > 0), F.floor(usable / (height + gap)) * columns).otherwise(0)


def _share(n: Column) -> Column:
    return F.when(n > 0, F.floor(F.lit(100.0).cast("double") / n * F.lit(10.0).cast("double")) / F.lit(10.0).cast("double")).otherwise(F.lit(NO_ROOM).cast("double"))


def board_share(length: Column, top: Column, bottom: Column, reserved: Column, height: Column, gap: Column, columns: Column) -> Column:
    """Per cent of the card columns that one board takes, cut to one decimal; unknown heights take 14.3, no room takes all."""
    return F.when(F.coalesce(height, F.lit(0.0)) <= 0, F.lit(UNKNOWN_SHARE).cast("double")).otherwise(_share(cards(length - top - bottom - reserved, height, gap, columns)))


def side_share(length: Column, sides: Column, height: Column, gap: Column) -> Column:
    unknown = (F.coalesce(height, F.lit(0.0)) <= 0) | (length <= 0) | (sides <= 0)
    return F.when(unknown, F.lit(UNKNOWN_SHARE).cast("double")).otherwise(_share(cards(length, height, gap, sides)))


def height_from_share(share: Column, length: Column, top: Column, bottom: Column, reserved: Column, gap: Column, columns: Column) -> Column:
    """The card height that a share stands for, to one decimal; null where none fits."""
    per = F.floor(F.floor(F.lit(100.0).cast("double") / F.nullif(share, F.lit(0.0))) / columns)
    return F.when(per > 0, F.bround((length - top - bottom - reserved) / per - gap, 1))


def limits(cabinets: DataFrame, boards: DataFrame) -> DataFrame:
    """(type, direction, board, share, terminals) of every cabinet side and board; boards are a dozen rows and broadcast."""
    share = board_share(*(F.col(c) for c in ("length", "top", "bottom", "reserved", "height", "gap", "columns")))
    rail = rail_terminals(F.col("length"), F.col("top"), F.col("bottom"), F.col("terminal_height"), F.col("rails"))
    return cabinets.crossJoin(F.broadcast(boards)).select("type", "direction", "board", share.alias("share"), rail.alias("terminals"))


def fill_preview(cabinets: DataFrame, boards: DataFrame, most: int = 50) -> DataFrame:
    """(type, direction, board, column, heights): what a column looks like when filled with one board, fifty at most."""
    one = cards(F.col("length") - F.col("top") - F.col("bottom") - F.col("reserved"), F.col("height"), F.col("gap"), F.lit(1))
    each = cabinets.crossJoin(F.broadcast(boards)).withColumn("column", F.explode(F.sequence(F.lit(0), F.col("columns").cast("int") - 1)))
    return each.select("type", "direction", "board", "column", F.array_repeat("height", F.least(one, F.lit(most)).cast("int")).alias("heights"))
