"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import op6_secrets as secret_scan
from . import op10_snapshots as snapshots
from . import op11_merkle as merkle
from . import op12_divergence as divergences
from . import op13_robust_graph as graphs
from .common import table
from .op1_token_counts import token_counts
from .op2_attention import attention_scores
from .op3_pii import pii
from .op4_byte_bpe import byte_bpe
from .op5_multi_index import nearest
from .op7_simhash import near_duplicates
from .op8_decontamination import leaks
from .op9_toxicity import toxicity

Query = Callable[[SparkSession, str], DataFrame]


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attention_scores(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii(table(spark, sf_dir, "documents"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secrets(table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.digest(table(spark, sf_dir, "conversations"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"), merkle.without_newlines())


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergences.divergence(table(spark, sf_dir, "documents"))


def op13_robust_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.near_duplicates(table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_token_counts, op2_attention, op3_pii, op4_byte_bpe, op5_multi_index, op6_secrets, op7_simhash, op8_decontamination, op9_toxicity, op10_snapshots, op11_merkle, op12_divergence, op13_robust_graph, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {"op6_secrets": secret_scan.ORACLE_SQL, "op10_snapshots": snapshots.ORACLE_SQL, "op11_merkle": merkle.ORACLE_SQL, "op12_divergence": divergences.ORACLE_SQL}
