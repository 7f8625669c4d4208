"""The corpus pipeline: documents in, packed training sequences out.

Each stage is one operator of ``fidspark.llm`` and works on all rows its
predecessor kept; what a stage returns is written as Parquet and read again
before the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fidspark.llm import exact_dedup, mixing, packing, quality_rules, simhash
from fidspark.llm.common import stage
from fidspark.llm.queries import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.keep_good(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component."""
    return simhash.keep_one(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; a document appears as often as it is drawn."""
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids with their places in the training sequences."""
    return packing.pack(docs, tokenizer_path(), with_ids=True)


STAGES = [("quality_rules", quality), ("exact_dedup", exact), ("simhash_near_dedup", near), ("mix_sources", mixture),
          ("best_fit_packing", packed)]

#: No SQL for the whole: the posterior of the rules, XXH64 fingerprints, the random draws and the tokenizer are beyond it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage_of in STAGES[:-1]:
        docs = stage(stage_of(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
