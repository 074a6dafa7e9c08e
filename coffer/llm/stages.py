"""The stages of the corpus pipeline, each one operator whose decisions take effect.

Each takes any columns beside those of ``documents`` along, whatever their names.
Repeated rows, null ids, null and empty texts and empty tables are defined by
the operators: quality scores rows alike that are alike, near copies keep the
first row of a group (texts without words are one), the benchmark matches no
text without words, personal data leaves texts without spans as they are, and
packing gives every row its end id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coffer.llm import decontaminate, mixture, privacy, quality, simhash
from coffer.llm.common import columns_of, fresh, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose neighbours vote at least 0.3 for label 1; without usable labels all stay."""
    space = quality.train(docs, table(spark, sf_dir, "labels"))
    (score,) = fresh(docs, "score")
    return quality.score(docs, space, into=score).where(F.col(score) >= 0.3).select(*columns_of(docs))


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the first row, of each group of near copies."""
    return simhash.drop_near_copies(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and disclosing terms masked in ``text``; a null text stays null."""
    return privacy.hide(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 4096 ids at the mixture of their sources, with the ids."""
    return mixture.pack(docs, with_ids=True)
