"""Fit-and-evaluate for one training set, and the comparison of several."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanspark.operators.classifier import BayesModel, fit
from gleanspark.operators.learner import Model
from gleanspark.operators.metrics import macro_f1
from gleanspark.sources.labelled import union_all


def validation_f1(real: DataFrame, model: Model) -> float:
    """Macro F1 on the validation rows of ``real(id, label, tokens, split)``; 0 without rows."""
    predicted = model.predict(real.filter("split = 'val'"), "id", ("label",))
    found = macro_f1(predicted, (), model.num_classes).first()
    return 0.0 if found["macro_f1"] is None else found["macro_f1"]


def fit_with(real: DataFrame, num_classes: int, extra: DataFrame | None = None) -> BayesModel:
    """Fit on the train split plus ``extra(label, tokens)``, always from scratch."""
    train = real.filter("split = 'train'").select("label", "tokens")
    more = None if extra is None else extra.select("label", "tokens")
    return fit(union_all(train, more), num_classes)


def compare_regimes(real: DataFrame, models: Mapping[str, Model]) -> DataFrame:
    """``regime, val_f1, test_f1``: each model on the held-out rows, all in one plan."""
    held_out = real.filter("split IN ('val', 'test')")
    predicted = [
        model.predict(held_out, "id", ("label", "split")).withColumn("regime", F.lit(name))
        for name, model in models.items()
    ]
    num_classes = next(iter(models.values())).num_classes
    scores = macro_f1(union_all(*predicted), ["regime", "split"], num_classes)
    # A split without rows has no F1; it is reported as 0 rather than left out.
    of = lambda split: F.expr(
        f"coalesce(max(macro_f1) FILTER (WHERE split = '{split}'), 0D) AS {split}_f1"
    )
    return scores.groupBy("regime").agg(of("val"), of("test"))
