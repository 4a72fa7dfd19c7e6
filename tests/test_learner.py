"""The learner of our own, and runs with other parts than the built-in ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanspark.config import SelectionConfig
from gleanspark.operators.embedding import embed_with
from gleanspark.operators.regression import LogisticRegression
from gleanspark.plans.loop import SelectionRun
from tests.test_loop import CONFIG, POOL, REAL, f1, log_of, vector, words

SCHEMA = "label int, tokens array<string>"
ROWS = [(l, words(t)) for _, t, l, _ in REAL] + [(0, []), (1, None)]


def inputs(rows):
    return np.array([np.append(vector(" ".join(t or [])), 1.0) for _, t in rows]), np.array([l for l, _ in rows])


def loss_and_gradient(weights, x, y, penalty):
    z = x @ weights.T
    p = np.exp(z - z.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    free = weights * np.append(np.ones(x.shape[1] - 1), 0)
    return -np.log(p[np.arange(len(y)), y]).mean(), (p - np.eye(len(weights))[y]).T @ x / len(y) + penalty * free


def steps(rows, classes, epochs, step, penalty):
    x, y = inputs(rows)
    weights, losses = np.zeros((classes, x.shape[1])), []
    for _ in range(epochs):
        loss, gradient = loss_and_gradient(weights, x, y, penalty)
        losses.append(loss)
        weights = weights - step * gradient
    return weights, [*losses, loss_and_gradient(weights, x, y, penalty)[0]]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, SCHEMA).selectExpr("label", "coalesce(tokens, array()) AS tokens")


@pytest.mark.parametrize("parts", [1, 7])
def test_gradient_steps_equal_plain_python(rows, parts):
    learner = LogisticRegression(CONFIG.embedding_dim, 6, "gradient", 2.0, 0.01)
    model = learner.trained(rows.repartition(parts), 3)
    weights, losses = steps(ROWS, 3, 6, 2.0, 0.01)
    assert model.weights == pytest.approx(weights, abs=1e-12)
    assert model.losses == pytest.approx(losses, abs=1e-12)
    assert losses[-1] < losses[0]


def test_lbfgs_falls_to_the_optimum(rows):
    model = LogisticRegression(CONFIG.embedding_dim, 60, "lbfgs", penalty=0.01).trained(rows, 2)
    x, y = inputs(ROWS)
    _, gradient = loss_and_gradient(model.weights, x, y, 0.01)
    assert np.abs(gradient).max() < 1e-5
    value = lambda w, loss: loss + 0.005 * (w[:, :-1] ** 2).sum()
    far, losses = steps(ROWS, 2, 3000, 2.0, 0.01)
    assert value(model.weights, model.losses[-1]) == pytest.approx(value(far, losses[-1]), abs=1e-8)
    assert len(model.losses) < 60


def test_no_rows_and_wrong_labels(spark, rows):
    empty = LogisticRegression(CONFIG.embedding_dim, 3).trained(rows.limit(0), 2)
    assert (empty.weights == 0).all()
    with pytest.raises(Exception, match="label outside"):
        LogisticRegression(CONFIG.embedding_dim, 1).trained(spark.createDataFrame([(5, ["a"])], SCHEMA), 2)
    with pytest.raises(ValueError, match="unknown method"):
        LogisticRegression(method="newton")


def test_predictions_and_history(spark, rows):
    model = LogisticRegression(CONFIG.embedding_dim, 4, "gradient").trained(rows, 2)
    docs = rows.withColumn("id", F.monotonically_increasing_id())
    x, _ = inputs(ROWS)
    z = x @ model.weights.T
    shares = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
    found = model.predict(docs, "id", ("label",)).orderBy("id").collect()
    assert [r["probs"] for r in found] == [pytest.approx(list(s), abs=1e-12) for s in shares]
    assert [r["prediction"] for r in found] == shares.round(10).argmax(axis=1).tolist()
    assert [r["epoch"] for r in model.loss_history(spark).orderBy("epoch").collect()] == [0, 1, 2, 3, 4]
    assert model.by_bucket(spark).count() == model.weights.size


def test_loop_with_regression_goes_on_and_equals_plain_fits(spark, tmp_path):
    """Each round's F1 is that of a fit on all rows kept so far; a restart reads the models back."""
    real = spark.createDataFrame(REAL, "id bigint, text string, label int, split string")
    pool = spark.createDataFrame(POOL, "cand_id bigint, text string, label int")
    learner = LogisticRegression(CONFIG.embedding_dim, 3, "gradient", 2.0, 0.01)
    folder = str(tmp_path / "run")
    short = SelectionConfig(num_classes=2, target_size=60, batch_size=30, max_rounds=2, embedding_dim=16)
    SelectionRun(spark, real, short, folder, learner=learner).run(pool)
    run = SelectionRun(spark, real, CONFIG, folder, learner=learner).run(pool)
    train = [(l, words(t)) for _, t, l, s in REAL if s == "train"]
    by_round = {}
    for r in run.curated().collect():
        by_round.setdefault(r["iteration"], []).append((r["label"], words(r["text"])))
    kept = []
    for row in log_of(run):
        kept += by_round.get(row[0], [])
        weights, _ = steps(train + kept, 2, 3, 2.0, 0.01)
        chance = lambda t: list(np.exp(np.append(vector(t), 1.0) @ weights.T))
        assert row[4] == pytest.approx(f1(chance, "val"))
    assert len(by_round) > 2
    scores = {r["regime"]: r["val_f1"] for r in run.regimes().collect()}
    whole, _ = steps(train + [(l, words(t)) for _, t, l in POOL], 2, 3, 2.0, 0.01)
    assert scores["naive_augmentation"] == pytest.approx(f1(lambda t: list(np.exp(np.append(vector(t), 1.0) @ whole.T)), "val"))
    assert scores["bandit_guided"] == pytest.approx(log_of(run)[-1][4])


def test_loop_with_own_vectors(spark):
    """Novelty is measured on the vectors a model gives; they are written with the tables."""

    def load():
        return lambda texts: [[float(len(t)), float(t.count("a")), 1.0] for t in texts]

    real = spark.createDataFrame(REAL, "id bigint, text string, label int, split string")
    pool = spark.createDataFrame(POOL, "cand_id bigint, text string, label int")
    own = lambda df: embed_with(df, "text", load, "vector")
    run = SelectionRun(spark, own(real), CONFIG).run(own(pool))
    unit = lambda t: (lambda v: v / (np.linalg.norm(v) + 1e-9))(np.array(load()([t])[0]))
    known = np.stack([unit(t) for _, t, _, s in REAL if s == "train"])
    novelty = {i: min(1.0, max(0.0, 1 - (known @ unit(t)).max())) for i, t, _ in POOL}
    for r in run.decisions.collect():
        assert r["novelty"] == pytest.approx(novelty[r["cand_id"]], abs=1e-9)
    assert "vector" in run.real.columns
    with pytest.raises(ValueError, match="vectors of their own"):
        SelectionRun(spark, own(real), CONFIG).run(pool)
    with pytest.raises(ValueError, match="vectors of their own"):
        SelectionRun(spark, real, CONFIG).run(own(pool))
