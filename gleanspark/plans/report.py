"""Report tables of a finished run, read from its result document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def learning_curve(document: DataFrame) -> DataFrame:
    """Validation F1 by iteration beside the two constant baselines."""
    return document.select(
        F.posexplode("bandit_guided.val_f1_history").alias("iteration", "val_f1"),
        F.col("baseline_real_only.val_f1").alias("real_only_val_f1"),
        F.col("naive_augmentation.val_f1").alias("naive_val_f1"),
    )


def regime_summary(document: DataFrame, places: int = 3) -> DataFrame:
    """Test F1 of the three regimes, rounded, with the text a chart is labelled by."""
    regime = lambda name: F.struct(F.lit(name).alias("regime"), F.col(f"{name}.test_f1"))
    names = ("baseline_real_only", "naive_augmentation", "bandit_guided")
    return document.select(F.inline(F.array(*[regime(n) for n in names]))).select(
        "regime",
        F.round("test_f1", places).alias("test_f1"),
        F.format_number("test_f1", places).alias("label"),
    )
