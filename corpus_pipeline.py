"""A training corpus from raw documents: ``run(spark, sf_dir)`` applies the stages in turn.

Each stage takes what the one before kept, as written Parquet, and all but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanspark.llm import decontaminate, language, mixing, pii, simhash
from gleanspark.llm.common import share_of, table
from gleanspark.storage import materialize

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts whose language cannot be told: without a letter, or of too mixed a kind."""
    training = docs.filter(share_of(F.col("doc_id"), 5) != 0)
    return language.identified(docs, training)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that with the smallest id, of each group linked by SimHash.

    Empty, blank and NULL texts are one group. Rows without an id come last in their group; of rows
    that agree in id and text one stays.
    """
    return simhash.deduplicated(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts a mark in place of personal data; drops nothing."""
    return pii.redacted(docs)


def source_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents the mix takes, and says how often in ``mix_times``."""
    return mixing.mixed(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language", by_language),
    ("near_duplicates", near_duplicates),
    ("benchmark_leaks", benchmark_leaks),
    ("personal_data", personal_data),
    ("source_weights", source_weights),
]

# Language shares, fingerprints and trained trees have no SQL; tests/llm holds the stages against
# plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
