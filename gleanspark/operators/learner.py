"""What a selection run asks of a classifier, and naive Bayes in that form."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from gleanspark.operators import classifier
from gleanspark.storage import write_table


class Model(ABC):
    """A fitted classifier over ``num_classes`` classes."""

    num_classes: int

    @abstractmethod
    def predict(self, docs: DataFrame, id_col: str, carry: Sequence[str] = ()) -> DataFrame:
        """``id, *carry, probs, prediction`` of ``docs(id, tokens, *carry)``, one row per document."""


class Learner(ABC):
    """Fits models into a folder and reads them back, so that a run can go on with them."""

    @abstractmethod
    def fit(self, rows: DataFrame, num_classes: int, path: str) -> Model:
        """The model of ``rows(label, tokens)``, written to ``path``."""

    @abstractmethod
    def load(self, spark: SparkSession, path: str) -> Model:
        """The model that was written to ``path``."""

    def grow(self, model: Model, added: DataFrame, whole: Callable[[], DataFrame], path: str) -> Model:
        """The model of the rows behind ``model`` and ``added``; ``whole()`` has all of them.

        Fits from scratch unless a learner can do with less.
        """
        return self.fit(whole(), model.num_classes, path)


class NaiveBayes(Learner):
    """Count tables: a model grows by the counts of what is added."""

    def fit(self, rows, num_classes, path):
        return classifier.model_of(write_table(classifier.word_counts(rows, num_classes), path))

    def load(self, spark, path):
        return classifier.model_of(spark.read.parquet(path))

    def grow(self, model, added, whole, path):
        counts = classifier.add_counts(model.counts, classifier.word_counts(added, model.num_classes))
        return classifier.model_of(write_table(counts, path))
