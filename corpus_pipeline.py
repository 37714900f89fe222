"""Training-data pipeline over ``documents``: language, near duplicates,
benchmark passages, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is
written as Parquet and read again as the next one's ``docs``.  All but the
last return the columns of their input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from inkwell.llm import decontaminate, langid, nearjoin, packing, pii
from inkwell.llm.common import finished, table


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters or of no language the model knows."""
    return langid.identified(docs)


def one_near_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near copies the one with the smallest doc_id."""
    return nearjoin.one_of_each(docs)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def masked_persons(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the text by its kind."""
    return pii.masked(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """Token pieces with their sequence and place."""
    return packing.packed(docs, tokenizer)


STAGES = [
    ("language_id", known_language),
    ("near_duplicates", one_near_copy),
    ("decontamination", no_benchmark),
    ("pii", masked_persons),
    ("packing", packed),
]

#: SQL expresses neither the language model, the verified groups nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        # What a stage wrote on the way goes when its result is there.
        docs = finished(spark, lambda: stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
