"""From raw documents to packed sequences: five stages, each written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wardline.llm import stages
from wardline.llm.common import dropped, table, written

STAGES = [
    ("language_id", stages.language),
    ("near_duplicates", stages.near_duplicates),
    ("pii_surrogates", stages.surrogates),
    ("source_mixing", stages.mixture),
    ("packing", stages.pack),
]

#: SQL cannot express tokenising, surrogates or the schedule; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir))
        dropped(before)
    return STAGES[-1][1](spark, docs, sf_dir)
