"""Intermediate tables: written once into the folder that all of a cluster's machines share, and read by every branch that follows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. A local run without one takes a temporary folder; on a cluster its absence is an error, since
    machines don't see each other's folders."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        folder = tempfile.mkdtemp(prefix="tables-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """df, computed now. What follows reads the table: its columns' expressions are neither repeated in each branch nor pushed into filters,
    and a lost machine costs no recomputation."""
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def placed(df: DataFrame, group: list[str], order: list[str | Column], name: str) -> DataFrame:
    """df with the place of each row in its group, from 1, for few groups that may each be as large as the table: rows are dealt by ranges of
    group and order, counted in each range alone, and moved by what the group has in earlier ranges."""
    ranged = stored(stored(df).repartitionByRange(*group, *order).withColumn("__range", F.spark_partition_id()))
    earlier = F.sum("n").over(Window.partitionBy(*group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    moved = ranged.groupBy("__range", *group).agg(F.count("*").alias("n")).select(F.col("__range").alias("__r"), *(F.col(g).alias(f"__{g}") for g in group), F.coalesce(earlier, F.lit(0)).alias("__moved"))
    rows = ranged.withColumn("__at", F.row_number().over(Window.partitionBy("__range", *group).orderBy(*order)))
    same = F.col("__range") == F.col("__r")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"__{g}"))
    return rows.join(F.broadcast(moved), same).select(*df.columns, (F.col("__at") + F.col("__moved")).alias(name))  # a row for each range and group
