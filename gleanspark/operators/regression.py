"""Multinomial logistic regression by sums of gradients over the whole training set.

A text is its word counts by hash bucket, at length one, and a constant. An epoch is one pass: each
task multiplies its batches with the weights and hands on one gradient; these are added up in about
the square root of the tasks, and the driver adds the few sums. Only weights and their gradient
come to the driver: classes x (buckets + 1) numbers, whatever the table holds.

Weights start at zero and all rows take part in every epoch, so two fits of one table agree but for
the order in which sums are taken. The loss by epoch is the mean cross-entropy of all rows, without
the penalty.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanspark.operators.classifier import probabilities
from gleanspark.operators.embedding import hashed_vector
from gleanspark.operators.learner import Learner, Model
from gleanspark.operators.novelty import stack, unit_rows
from gleanspark.storage import materialize, write_table

DIM = 256
EPOCHS = 20
STEP = 4.0
PENALTY = 1e-4
# Steps that L-BFGS remembers, and halvings of a step before it is given up.
HISTORY = 8
HALVINGS = 12
# A step has to win this share of what the slope promises.
ARMIJO = 1e-4

MODEL_SCHEMA = "weights array<array<double>>, losses array<double>"


def inputs_of(counts: pa.Array) -> np.ndarray:
    """Word counts at length one, and a constant."""
    vectors = unit_rows(stack(counts))
    return np.hstack([vectors, np.ones((len(vectors), 1))])


def class_shares(scores: np.ndarray) -> np.ndarray:
    grown = np.exp(scores - scores.max(axis=1, keepdims=True))
    return grown / grown.sum(axis=1, keepdims=True)


@dataclass(frozen=True)
class LinearModel(Model):
    """``weights``: a row per class, a column per bucket and one for the constant."""

    weights: np.ndarray
    losses: tuple[float, ...] = ()

    @property
    def num_classes(self) -> int:
        return len(self.weights)

    @property
    def dim(self) -> int:
        return self.weights.shape[1] - 1

    def scores(self, tokens: Column) -> Column:
        weights = self.weights

        @F.arrow_udf("array<double>")
        def multiply(vectors: pa.Array) -> pa.Array:
            if not len(vectors):
                return pa.array([], pa.list_(pa.float64()))
            found = inputs_of(vectors) @ weights.T
            offsets = np.arange(0, found.size + 1, found.shape[1], dtype="int32")
            return pa.ListArray.from_arrays(offsets, found.ravel())

        return multiply(hashed_vector(tokens, self.dim))

    def predict(self, docs: DataFrame, id_col: str, carry: Sequence[str] = ()) -> DataFrame:
        scored = docs.select(id_col, *carry, self.scores(F.col("tokens")).alias("_z"))
        each = [F.get("_z", F.lit(c)).alias(f"z_{c}") for c in range(self.num_classes)]
        return probabilities(scored.select(id_col, *carry, *each))

    def by_bucket(self, spark: SparkSession) -> DataFrame:
        """``class, bucket, weight``; the last bucket is the constant."""
        rows = [(c, b, float(w)) for c, row in enumerate(self.weights) for b, w in enumerate(row)]
        return spark.createDataFrame(rows, "class int, bucket int, weight double")

    def loss_history(self, spark: SparkSession) -> DataFrame:
        """``epoch, loss``: the mean loss after each epoch; epoch 0 is the start."""
        return spark.createDataFrame(list(enumerate(self.losses)), "epoch int, loss double")


class Objective:
    """Loss and gradient of ``rows(label, tokens)``, a pass over a written table per call."""

    def __init__(self, rows: DataFrame, num_classes: int, dim: int, penalty: float):
        checked = F.expr(
            f"CASE WHEN label BETWEEN 0 AND {num_classes - 1} THEN label "
            f"ELSE int(raise_error('label outside 0..{num_classes - 1}')) END AS label"
        )
        self.train = materialize(rows.select(checked, hashed_vector(F.col("tokens"), dim).alias("vector")), "regression")
        self.shape, self.penalty = (num_classes, dim + 1), penalty
        self.sums = max(1, isqrt(self.train.rdd.getNumPartitions()))

    def __call__(self, weights: np.ndarray) -> tuple[float, float, np.ndarray]:
        """(mean loss, the same with the penalty, gradient of the latter)."""
        schema = "loss double, n bigint, gradient array<double>"
        shape = self.shape

        def row(loss: float, n: int, gradient: np.ndarray) -> pa.RecordBatch:
            arrays = [pa.array([loss]), pa.array([n]), pa.array([gradient.ravel()], pa.list_(pa.float64()))]
            return pa.RecordBatch.from_arrays(arrays, ["loss", "n", "gradient"])

        def one_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            loss, n, gradient = 0.0, 0, np.zeros(shape)
            for batch in batches:
                if not batch.num_rows:
                    continue
                inputs, label = inputs_of(batch.column("vector")), batch.column("label").to_numpy()
                share, place = class_shares(inputs @ weights.T), np.arange(len(label))
                loss -= float(np.log(share[place, label]).sum())
                share[place, label] -= 1
                gradient += share.T @ inputs
                n += len(label)
            yield row(loss, n, gradient)

        def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            loss, n, gradient = 0.0, 0, np.zeros(shape)
            for batch in batches:
                for one in batch.to_pylist():
                    loss, n = loss + one["loss"], n + one["n"]
                    gradient += np.array(one["gradient"]).reshape(shape)
            yield row(loss, n, gradient)

        parts = self.train.mapInArrow(one_pass, schema).repartition(self.sums).mapInArrow(added, schema).collect()
        n = max(1, sum(p["n"] for p in parts))
        free = weights.copy()
        free[:, -1] = 0
        loss = sum(p["loss"] for p in parts) / n
        gradient = sum(np.array(p["gradient"]) for p in parts).reshape(shape) / n + self.penalty * free
        return loss, loss + self.penalty / 2 * float((free**2).sum()), gradient


def descended(objective: Objective, epochs: int, step: float) -> LinearModel:
    """``epochs`` steps of one length along the gradient."""
    weights = np.zeros(objective.shape)
    losses = []
    for _ in range(epochs):
        loss, _, gradient = objective(weights)
        losses.append(loss)
        weights = weights - step * gradient
    losses.append(objective(weights)[0])
    return LinearModel(weights, tuple(losses))


def two_loops(gradient: np.ndarray, history: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The direction of L-BFGS from the steps remembered, (change of weights, change of gradient)."""
    q, alphas = gradient.ravel().copy(), []
    for s, y in reversed(history):
        alphas.append(s @ q / (s @ y))
        q -= alphas[-1] * y
    if history:
        s, y = history[-1]
        q *= (s @ y) / (y @ y)
    for (s, y), alpha in zip(history, reversed(alphas)):
        q += (alpha - y @ q / (s @ y)) * s
    return -q.reshape(gradient.shape)


def searched(objective: Objective, epochs: int, tolerance: float = 1e-6) -> LinearModel:
    """At most ``epochs`` steps of L-BFGS; a step is halved until it wins enough."""
    weights = np.zeros(objective.shape)
    loss, value, gradient = objective(weights)
    losses, history = [loss], []
    for _ in range(epochs):
        if np.abs(gradient).max() < tolerance:
            break
        direction, length = two_loops(gradient, history), 1.0
        slope = float((gradient * direction).sum())
        for _ in range(HALVINGS):
            new = weights + length * direction
            new_loss, new_value, new_gradient = objective(new)
            if new_value <= value + ARMIJO * length * slope:
                break
            length /= 2
        else:
            break
        s, y = (new - weights).ravel(), (new_gradient - gradient).ravel()
        if s @ y > 1e-12:
            history = [*history, (s, y)][-HISTORY:]
        weights, value, gradient = new, new_value, new_gradient
        losses.append(new_loss)
    return LinearModel(weights, tuple(losses))


@dataclass(frozen=True)
class LogisticRegression(Learner):
    """``method``: "lbfgs", or "gradient" for plain steps of length ``step``."""

    dim: int = DIM
    epochs: int = EPOCHS
    method: str = "lbfgs"
    step: float = STEP
    penalty: float = PENALTY

    def __post_init__(self):
        if self.method not in ("lbfgs", "gradient"):
            raise ValueError(f"unknown method {self.method!r}; known are 'gradient' and 'lbfgs'")

    def trained(self, rows: DataFrame, num_classes: int) -> LinearModel:
        objective = Objective(rows, num_classes, self.dim, self.penalty)
        if self.method == "gradient":
            return descended(objective, self.epochs, self.step)
        return searched(objective, self.epochs)

    def fit(self, rows, num_classes, path):
        model = self.trained(rows, num_classes)
        row = [(model.weights.tolist(), list(model.losses))]
        write_table(rows.sparkSession.createDataFrame(row, MODEL_SCHEMA), path)
        return model

    def load(self, spark, path):
        row = spark.read.schema(MODEL_SCHEMA).parquet(path).first()
        return LinearModel(np.array(row["weights"]), tuple(row["losses"]))
