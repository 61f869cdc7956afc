"""Documents to packed training sequences, in five stages.

Each stage gets what the one before it wrote. All but the last give rows with the columns of
``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skygauge.llm import hamming, mixing, naming, packing, quality
from skygauge.session import scratch_path, stage

ROW = "_row"
#: Least Jaccard similarity of near copies, in percent (the op8 query's contract has 85).
NEAR_PERCENT = 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy keeps."""
    return quality.apply_policy(docs)


def _numbered(docs: DataFrame) -> DataFrame:
    """Rows with a number that stays: the table is saved with it."""
    return stage(docs.withColumn(ROW, F.monotonically_increasing_id()), "numbered")


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: that with the smallest doc_id."""
    numbered = _numbered(docs)
    kept = naming.exact_groups(numbered, ROW).filter("kept").select(F.col("rid").alias(ROW))
    return numbered.join(kept, ROW, "left_semi").drop(ROW)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: that with the smallest doc_id."""
    numbered = _numbered(docs)
    kept = hamming.near_groups(numbered, ROW, NEAR_PERCENT).filter("stays").select(F.col("rid").alias(ROW))
    return numbered.join(kept, ROW, "left_semi").drop(ROW)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows repeated, left out or cut so that each source has its budget of words."""
    return mixing.mix_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with the sequence and the place they are packed at."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("source_mix", source_mix),
    ("packing", packing_stage),
]

#: Tokenizing and packing have no SQL form; tests compare the pipeline with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage_of in STAGES:
        path = scratch_path(spark, name)
        stage_of(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
