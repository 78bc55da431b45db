"""Run logs as streams: append batches of decisions as JSON, and count levels in windows with late data bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def append_log(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Each batch is appended as JSON in a folder of its own number, so a batch that runs again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").json(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def level_counts(log: DataFrame, width: str = "10 minutes", late: str = "5 minutes") -> DataFrame:
    """Lines per window and level; the same on a table and on a stream."""
    return log.withWatermark("created", late).groupBy(F.window("created", width), "level").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "level", "n")
