"""The training-data pipeline: STAGES in order, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from recordlake.llm import stages
from recordlake.llm.common import cut, drop, table

STAGES = [
    ("quality_rules", stages.quality_rules),
    ("near_duplicates", stages.near_duplicate_groups),
    ("suffix_dedup", stages.repeated_strings),
    ("decontamination", stages.benchmark_passages),
    ("packing", stages.packed_sequences),
]

#: SQL can't express the stages; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of documents; what a stage returns is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
            if i:
                drop(before)
    return docs
