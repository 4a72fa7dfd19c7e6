"""Quality measures over predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def confusion(predicted: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Row counts per (label, prediction): at most classes squared rows per group."""
    return predicted.groupBy(*by, "label", "prediction").agg(F.count(F.lit(1)).alias("n"))


def class_f1(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """F1 of every class seen as label or prediction; 0 without a true positive."""
    hit = F.col("label") == F.col("prediction")
    part = lambda cls, tp, fp, fn: F.struct(
        F.col(cls).alias("class"), tp.alias("tp"), fp.alias("fp"), fn.alias("fn")
    )
    zero, n = F.lit(0).cast("bigint"), F.col("n")
    parts = F.when(hit, F.array(part("label", n, zero, zero))).otherwise(
        F.array(part("label", zero, zero, n), part("prediction", zero, n, zero))
    )
    return (
        counts.select(*by, F.inline(parts))
        .groupBy(*by, "class")
        .agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
        .withColumn("f1", 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn")))
    )


def macro_f1(
    predicted: DataFrame, by: Sequence[str] = (), num_classes: int | None = None
) -> DataFrame:
    """Unweighted mean of the class F1s of ``predicted(label, prediction)``.

    Knowing that the classes are 0 … num_classes - 1 lets one aggregation count them all; a label
    or prediction outside them is an error then.
    """
    if num_classes is None:
        per_class = class_f1(confusion(predicted, by), by)
        return per_class.groupBy(*by).agg(F.avg("f1").alias("macro_f1"))
    tallies = {
        f"_{name}_{c}": f"count_if({side} = {c})"
        for c in range(num_classes)
        for name, side in (("label", "label"), ("pred", "prediction"))
    } | {
        f"_hit_{c}": f"count_if(label = {c} AND prediction = {c})" for c in range(num_classes)
    }
    known = lambda c: (
        f"CASE WHEN {c} BETWEEN 0 AND {num_classes - 1} THEN {c} "
        f"ELSE int(raise_error('{c} outside 0..{num_classes - 1}')) END AS {c}"
    )
    checked = predicted.select(*by, F.expr(known("label")), F.expr(known("prediction")))
    counted = checked.groupBy(*by).agg(*[F.expr(f"{e} AS {n}") for n, e in tallies.items()])
    # tp / (tp + (fp + fn) / 2) is 2 tp over the rows labelled plus the rows predicted; the
    # quotient is NULL for a class seen in neither, which leaves it out of the mean.
    f1 = [f"try_divide(2 * _hit_{c}, _label_{c} + _pred_{c})" for c in range(num_classes)]
    total = " + ".join(f"coalesce({x}, 0D)" for x in f1)
    seen = " + ".join(f"int({x} IS NOT NULL)" for x in f1)
    return counted.select(*by, F.expr(f"try_divide({total}, {seen}) AS macro_f1"))


def accepted_counts(decisions: DataFrame, by: Sequence[str] = (), more: Sequence[Column] = ()) -> DataFrame:
    """Rows, accepted rows, and the arm a round stands for: 1 once anything was accepted."""
    return decisions.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_batch"),
        F.count_if(F.col("action") == 1).alias("n_accepted"),
        F.coalesce(F.max("action"), F.lit(0)).alias("arm"),
        *more,
    )


def arm_context(columns: Sequence[str]) -> Column:
    """Aggregate: the mean of ``columns`` over the rows that took the arm a round stands for."""
    mean = lambda c: F.coalesce(F.avg(F.when(F.col("action") == 1, F.col(c))), F.avg(c))
    return F.array(*[mean(c) for c in columns])
