from math import log

import pytest
from pyspark.sql import functions as F

from gleanspark.functions import hashing, signals, text, vectors


@pytest.mark.parametrize(
    "probs, expected",
    [
        ([0.5, 0.5], 0.99999999711461),
        ([1.0, 0.0], -1.4426951595e-09),
        ([0.9, 0.1], 0.4689955907),
        ([0.25] * 4, 0.9999999971),
        ([0.7, 0.1, 0.1, 0.1], 0.6783898218),
        ([1.0], -1e-9),
    ],
)
def test_uncertainty(values, probs, expected):
    [(found,)] = values([(probs,)], "probs array<double>", signals.uncertainty())
    assert found == pytest.approx(expected, abs=1e-9)


def test_uncertainty_does_not_depend_on_class_order(values):
    rows = [([0.2, 0.3, 0.5],), ([0.5, 0.2, 0.3],)]
    (a,), (b,) = values(rows, "probs array<double>", signals.uncertainty())
    assert a == pytest.approx(b, abs=1e-12)


def test_verifier_takes_the_claimed_label(values):
    rows = [([0.3, 0.7], 1), ([0.3, 0.7], 0)]
    found = values(rows, "probs array<double>, label int", signals.verifier_confidence())
    assert found == [(0.7,), (0.3,)]


@pytest.mark.parametrize("label", [2, -1, None])
def test_verifier_rejects_labels_outside_the_classes(values, label):
    with pytest.raises(Exception, match="label outside the classes"):
        values([([0.3, 0.7], label)], "probs array<double>, label int", signals.verifier_confidence())


def test_softmax_and_first_argmax(values):
    [(a, b)] = values([(1.0, 3.0)], "z_0 double, z_1 double", *signals.softmax(["z_0", "z_1"]))
    assert (a, b) == (pytest.approx(0.11920292202), pytest.approx(0.88079707798))
    assert values([(5.0,)], "z double", *signals.softmax(["z"])) == [(1.0,)]
    rows = [([0.4, 0.4, 0.2],), ([0.1, 0.2, 0.7],)]
    assert values(rows, "p array<double>", signals.first_argmax("p")) == [(0,), (2,)]


def test_context_order_and_weight(values):
    schema = "uncertainty double, novelty double, verifier double"
    [(context, weight)] = values(
        [(0.3, 0.6, 0.9)], schema, signals.context(), signals.context_weight()
    )
    assert context == [0.3, 0.6, 0.9] and weight == pytest.approx(0.6)


def test_l2_normalise(values):
    rows = [([3.0, 4.0],), ([0.0, 0.0],)]
    (unit,), (zero,) = values(rows, "v array<double>", vectors.l2_normalise(F.col("v")))
    assert unit == pytest.approx([0.6, 0.8], abs=1e-9) and zero == [0.0, 0.0]


def test_dot_and_clip(values):
    schema = "a array<double>, b array<double>"
    dot = vectors.dot(F.col("a"), F.col("b"))
    assert values([([1.0, 2.0], [3.0, 4.0])], schema, dot) == [(11.0,)]
    clip = vectors.clip_unit(F.col("x"))
    assert values([(-0.5,), (0.5,), (1.5,), (None,)], "x double", clip) == [(0,), (0.5,), (1,), (None,)]


WORDY = "Ab, cd! " * 300


@pytest.mark.parametrize(
    "line, expected",
    [
        ("Éçole d'ÉTÉ, 2024!", ["éçole", "d", "été", "2024"]),
        ("", []),
        (None, []),
        ("!!! ...", []),
        ("  one", ["one"]),
        ("x" * 5000, ["x" * 5000]),
        (WORDY, ["ab", "cd"] * 64),
    ],
)
def test_tokens(values, line, expected):
    assert values([(line,)], "line string", text.tokens(F.col("line"), 128)) == [(expected,)]


def test_tokens_of_the_whole_text_by_default(values):
    assert values([(WORDY,)], "line string", text.tokens(F.col("line"))) == [(["ab", "cd"] * 300,)]


def test_tokens_equal_cutting_the_whole_list(spark):
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text")
    # Final sigma looks at the letter behind; the dotted capital I falls apart when lowered.
    odd = [(w * 120,) for w in ("ΑΣ'Α ", "ΑΣ 1", "İx ", "a ΑΣ")] + [("x " * 127 + "ΑΣ" + tail,)
           for tail in ("", "'Α", ".", " Α", "'1Α")]
    documents = documents.unionByName(spark.createDataFrame(odd, "text string"))
    whole = r"slice(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+', 0), 1, 128)"
    both = documents.select(text.tokens(F.col("text"), 128).alias("a"), F.expr(whole).alias("b"))
    assert both.filter("a <> b").count() == 0


def test_draws_are_uniform_and_keyed(spark):
    ids = spark.range(20_000)
    draw = hashing.uniform(42, "x", F.col("id"))
    row = ids.agg(F.avg(draw), F.min(draw), F.max(draw), F.countDistinct(draw)).first()
    assert row[0] == pytest.approx(0.5, abs=0.01) and row[1] >= 0 and row[2] < 1 and row[3] == 20_000
    again = ids.repartition(7).select("id", draw.alias("u")).exceptAll(ids.select("id", draw.alias("u")))
    assert again.count() == 0
    safe = ids.agg(F.min(F.ln(hashing.positive_uniform(42, "x", F.col("id"))))).first()[0]
    assert safe > log(2.0**-53)
