"""Corpus preparation: quality, near copies, benchmark leaks, personal data, packing.

Each stage takes (spark, docs, sf_dir), with docs the Parquet table that its
predecessor wrote, and returns a DataFrame; all but the last return the columns
of ``docs``. Labels and the benchmark are read from ``sf_dir``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from coffer.llm import stages
from coffer.llm.common import materialize, table

STAGES = [
    ("quality", stages.quality_stage),
    ("near_copies", stages.near_copy_stage),
    ("benchmark", stages.benchmark_stage),
    ("personal_data", stages.personal_data_stage),
    ("packing", stages.packing_stage),
]

#: A classifier, tokenisation and hashing have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
