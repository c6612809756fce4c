"""The corpus pipeline: documents through the stages in order, each written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quantfield.llm.common import new_path, table
from quantfield.llm.mixing import mix
from quantfield.llm.near_duplicates import keep_one
from quantfield.llm.packing import pack_digest
from quantfield.llm.quality import keep_good
from quantfield.llm.repeats import without_repeats


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates: the one with the smallest doc_id."""
    return keep_one(docs)


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that repeat; n_chars counted anew."""
    return without_repeats(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source repeated or thinned to its target; documents taken twice are two rows."""
    return mix(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in windows of 2048 tokens."""
    return pack_digest(docs)


STAGES = [("quality", quality_stage), ("near duplicates", near_duplicate_stage), ("repeats", repeats_stage), ("mixing", mixing_stage), ("packing", packing_stage)]

#: Near-duplicate stages and tokenizers have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k + 1 == len(STAGES):
            return out
        path = new_path(spark, f"pipeline-{name.replace(' ', '-')}")
        out.write.option("compression", "zstd").parquet(path)
        docs = spark.read.parquet(path)
    return docs
