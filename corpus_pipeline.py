"""A corpus pipeline: toxicity, near copies, benchmark leaks, personal data, byte-level BPE.

Each stage takes all that the one before kept, as Parquet read again. All but the last return the columns of documents.

In every stage null and empty texts are texts without words: they aren't toxic or leaks, they are copies of one another, and are encoded to
no ids; a null text stays null up to the encoding. Texts of any length are read whole. Null ids are kept and come last among copies. Of rows
that equal one another one stays. An empty table stays empty. Further columns, whatever their names, are carried to the last stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagwright.llm.common import cut, remove, table, written
from tagwright.llm.near_copies import one_of_each
from tagwright.llm.op3_pii import masked
from tagwright.llm.op4_byte_bpe import byte_bpe
from tagwright.llm.op8_decontamination import clean
from tagwright.llm.op9_toxicity import toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored as toxic (0.5 or more) go."""
    scored = toxicity(docs, table(spark, sf_dir, "labels"), keep=docs.columns)
    return scored.filter(F.col(scored.columns[-1]) < 0.5).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of copies and near copies the document with the smallest id stays."""
    return one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return clean(docs, table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; n_chars follows the text."""
    out = masked(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded bytes."""
    return byte_bpe(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_leaks),
    ("pii", mask_personal_data),
    ("byte_bpe", encode),
]
#: SQL expresses neither the models nor the joins of fingerprints; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; what a stage wrote besides its result is removed once the result stands, and that once the next one does."""
    docs = table(spark, sf_dir, "documents")
    before = written()
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
        made = [p for p in written() if p not in before]
        remove(spark, made[:-1])
    return docs
