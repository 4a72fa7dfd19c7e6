"""The result document of a run: one nested JSON record."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The names and shape of the result document.
SCORES = "struct<val_f1: double, test_f1: double>"
RESULT_SCHEMA = (
    f"baseline_real_only {SCORES}, naive_augmentation {SCORES}, "
    "bandit_guided struct<val_f1_history: array<double>, reward_history: array<double>, "
    "curated_pool_size: bigint, test_f1: double>"
)


def result_document(iterations: DataFrame, regimes: DataFrame) -> DataFrame:
    """Nest the round table and the regime table into one record."""
    step = lambda column: F.when(
        F.col(column).isNotNull(), F.struct("iteration", F.col(column).alias("value"))
    )
    ordered = lambda column: F.transform(
        F.array_sort(F.collect_list(step(column))), lambda s: s["value"]
    )
    of = lambda regime, column: F.max(F.when(F.col("regime") == regime, F.col(f"regime_{column}")))
    pair = lambda regime: F.struct(
        of(regime, "val_f1").alias("val_f1"), of(regime, "test_f1").alias("test_f1")
    )
    scores = regimes.select(
        "regime", F.col("val_f1").alias("regime_val_f1"), F.col("test_f1").alias("regime_test_f1")
    )
    rounds = iterations.select("iteration", "val_f1", "reward", "curated_total")
    # Round rows and regime rows are folded together, each aggregate skipping the other kind.
    return rounds.unionByName(scores, allowMissingColumns=True).agg(
        pair("real_only").alias("baseline_real_only"),
        pair("naive_augmentation").alias("naive_augmentation"),
        F.struct(
            ordered("val_f1").alias("val_f1_history"),
            ordered("reward").alias("reward_history"),
            F.coalesce(F.max("curated_total"), F.lit(0).cast("bigint")).alias("curated_pool_size"),
            of("bandit_guided", "test_f1").alias("test_f1"),
        ).alias("bandit_guided"),
    )


def write_result(document: DataFrame, path: str) -> None:
    document.write.mode("overwrite").json(path)


def read_result(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RESULT_SCHEMA).option("multiLine", True).json(path)
