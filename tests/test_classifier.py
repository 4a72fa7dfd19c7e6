from collections import Counter
from math import exp, log

import pytest
from pyspark.sql import functions as F

from gleanspark.operators import classifier, metrics
from gleanspark.operators.logistic import fit_logistic, predict_logistic

TRAIN = [
    (0, ["good", "film"]),
    (0, ["good", "good", "story"]),
    (1, ["bad", "film"]),
    (1, []),
]
DOCS = [(0, ["good", "film", "unknown"]), (1, ["bad"] * 5), (2, []), (3, ["nothing", "known"])]


def by_hand(train, tokens, classes):
    """Class probabilities from the formulas, in plain Python."""
    counts = [Counter(w for label, words in train if label == c for w in words) for c in range(classes)]
    vocabulary = {w for c in counts for w in c}
    priors = [log((sum(l == c for l, _ in train) + 1) / (len(train) + classes)) for c in range(classes)]
    known = [w for w in tokens if w in vocabulary]
    z = []
    for c in range(classes):
        total = sum(counts[c].values())
        likelihood = sum(log((counts[c][w] + 1) / (total + len(vocabulary))) for w in known)
        z.append(priors[c] + (likelihood / len(known) if known else 0))
    grown = [exp(x - max(z)) for x in z]
    return [g / sum(grown) for g in grown]


@pytest.fixture(scope="module")
def train(spark):
    return spark.createDataFrame(TRAIN, "label int, tokens array<string>")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "id bigint, tokens array<string>")


@pytest.mark.parametrize("classes", [2, 3])
@pytest.mark.parametrize("options", [{}, {"broadcast_bytes": -1, "salts": 3}])
def test_probabilities_follow_the_formulas(train, docs, classes, options):
    model = classifier.fit(train, classes)
    for row in classifier.predict(docs, model, "id", **options).collect():
        expected = by_hand(TRAIN, DOCS[row["id"]][1], classes)
        assert row["probs"] == pytest.approx(expected, abs=1e-12)
        assert row["prediction"] == expected.index(max(expected))
        assert sum(row["probs"]) == pytest.approx(1)


def test_model_totals(train):
    model = classifier.fit(train, 2)
    assert model.doc_counts == (2, 2) and model.word_counts == (5, 2) and model.vocabulary == 4


def test_adding_counts_equals_a_fit_on_the_union(spark, train):
    extra = spark.createDataFrame([(1, ["bad", "story"]), (0, ["new"])], "label int, tokens array<string>")
    whole = classifier.word_counts(train.unionByName(extra), 2)
    summed = classifier.add_counts(classifier.word_counts(train, 2), classifier.word_counts(extra, 2))
    assert whole.exceptAll(summed).count() == 0 and summed.exceptAll(whole).count() == 0


@pytest.mark.parametrize("label", [2, -1, None])
def test_labels_outside_the_classes_fail(spark, label):
    with pytest.raises(Exception, match="label outside"):
        classifier.fit(spark.createDataFrame([(label, ["x"])], "label int, tokens array<string>"), 2)


def test_an_empty_training_set_gives_even_classes(spark, docs):
    model = classifier.fit(spark.createDataFrame([], "label int, tokens array<string>"), 2)
    assert all(r["probs"] == [0.5, 0.5] and r["prediction"] == 0
               for r in classifier.predict(docs, model, "id").collect())


def test_train_loss(spark):
    rows = [(0, [0.5, 0.5]), (1, [0.75, 0.25])]
    df = spark.createDataFrame(rows, "label int, probs array<double>")
    assert df.agg(classifier.mean_loss(df)).first()[0] == pytest.approx((log(2) + log(4)) / 2)


def test_logistic_separates_an_easy_task(spark):
    rows = [(i, i % 2, ["good" if i % 2 else "bad", f"w{i % 5}"]) for i in range(60)]
    df = spark.createDataFrame(rows, "id bigint, label int, tokens array<string>")
    found = predict_logistic(df, fit_logistic(df)).collect()
    assert all(r["prediction"] == r["label"] and sum(r["probs"]) == pytest.approx(1) for r in found)


def predictions(spark, pairs):
    return spark.createDataFrame(pairs, "label int, prediction int")


SIX = list(zip([0, 0, 1, 2, 2, 1], [0, 0, 0, 1, 2, 1]))


@pytest.mark.parametrize("classes", [None, 3, 7])
def test_macro_f1(spark, classes):
    found = metrics.macro_f1(predictions(spark, SIX), num_classes=classes).first()["macro_f1"]
    assert found == pytest.approx(0.6555555556)


@pytest.mark.parametrize("classes", [None, 2])
def test_macro_f1_is_not_weighted_by_support(spark, classes):
    pairs = [(0, 0)] * 161 + [(0, 1)] * 83 + [(1, 0)] * 94 + [(1, 1)] * 162
    found = metrics.macro_f1(predictions(spark, pairs), num_classes=classes).first()["macro_f1"]
    assert found == pytest.approx(0.6459986, abs=1e-7)


@pytest.mark.parametrize("classes", [None, 3])
def test_macro_f1_counts_classes_seen_on_either_side(spark, classes):
    # Class 2 is predicted and never true, class 1 is true and never predicted: both score 0.
    pairs = [(0, 0), (1, 2)]
    found = metrics.macro_f1(predictions(spark, pairs), num_classes=classes).first()["macro_f1"]
    assert found == pytest.approx(1 / 3)


def test_round_arm_is_accept_once_anything_was_accepted(spark):
    rows = [(1, 0), (1, 1), (1, 0), (2, 0)]
    found = metrics.accepted_counts(spark.createDataFrame(rows, "batch_no int, action int"), ["batch_no"])
    assert sorted(tuple(r) for r in found.collect()) == [(1, 3, 1, 1), (2, 1, 0, 0)]
    assert tuple(metrics.accepted_counts(spark.createDataFrame([], "action int")).first()) == (0, 0, 0)


def test_macro_f1_refuses_labels_outside_the_classes(spark):
    with pytest.raises(Exception, match="outside 0..1"):
        metrics.macro_f1(predictions(spark, [(0, 0), (2, 0)]), num_classes=2).first()


def test_rows_that_share_an_id_are_not_merged(spark):
    docs = spark.createDataFrame([(5, 0, ["a"]), (5, 1, ["b"])], "id bigint, label int, tokens array<string>")
    with pytest.raises(Exception, match="same id"):
        classifier.predict(docs, classifier.fit(docs, 2), "id").collect()


@pytest.mark.parametrize("hot", [1000, 2])
def test_of_a_large_model_only_rare_words_are_shuffled(spark, monkeypatch, hot):
    """Frequent words of a model over the limit meet the texts by broadcast, with no copies of the model."""
    monkeypatch.setattr(classifier, "HOT_WORDS", hot)
    train = [(i % 2, ["the"] * 9 + ["of"] * (3 + i % 2) + [f"rare{i}"]) for i in range(40)]
    docs = [(0, ["the", "rare1", "rare2", "new"]), (1, ["of"] * 4), (2, []), (3, ["rare39"] * 3), (4, ["new"])]
    model = classifier.fit(spark.createDataFrame(train, "label int, tokens array<string>"), 2)
    df = spark.createDataFrame(docs, "id bigint, tokens array<string>")
    # The words in every text have some 20 bytes each, the rare ones over 800 together.
    predicted = classifier.predict(df, model, "id", broadcast_bytes=60)
    assert model.size_bytes > 800
    for row in predicted.collect():
        assert row["probs"] == pytest.approx(by_hand(train, docs[row["id"]][1], 2), abs=1e-12)
    words = df.select("id", F.posexplode_outer("tokens").alias("_place", "token"))
    joined = classifier.with_weights(words, "id", model, 60, 64)
    # Only words that are hot and not sent out have copies.
    assert ("sequence(" in joined._jdf.queryExecution().optimizedPlan().toString()) == (hot == 1000)
    # A row per word, and one more for each rare word the model knows.
    assert joined.count() == words.count() + 5
