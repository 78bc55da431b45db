"""What the corpus operators share: reading tables, cutting lineage in the shared folder, and ASCII lower case."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))
_UPPER_AZ, _LOWER_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Tables that cut() has written and that nobody has removed, by path.
_WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where it is unset a local run takes a temporary one; a cluster's
    executors would not see each other's, so there it is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="checkpoint-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write df as Parquet into the shared folder and read it again: a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables that cut() wrote and that no DataFrame still in use reads."""
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        if path in _WRITTEN:
            _WRITTEN.remove(path)


def written() -> list[str]:
    return list(_WRITTEN)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, with as many underscores before them as keep them apart from df's columns."""
    taken, lead = {c.lower() for c in df.columns}, "__"
    while any(f"{lead}{n}".lower() in taken for n in names):
        lead += "_"
    return [f"{lead}{n}" for n in names]


def words_az(text: bytes) -> list[bytes]:
    """The words of a UTF-8 text, A-Z lower-cased: runs of anything but the space and the five ASCII control spaces."""
    return text.translate(_LOWER).split()


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow column as UTF-8; null is empty."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def lower_az_column(column: Column) -> Column:
    return F.translate(column, _UPPER_AZ, _LOWER_AZ)


def crc_mod(column: Column, modulus: int) -> Column:
    """crc32 of the value as text, modulo; a null counts as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % modulus


def arrow_map(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(function, schema)


def slices(batch: pa.RecordBatch, text: int = 1, most_chars: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts add up to about most_chars bytes, so that long texts don't pile up as Python objects."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > most_chars:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield batch.slice(start)
