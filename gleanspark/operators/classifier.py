"""Multinomial naive Bayes as aggregates: the distributed, exact text classifier.

A model is one table with a row per known word and a count per class. The row whose word
is NULL holds the number of documents per class, so one pass fits a model and two models
are merged by adding rows up.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import log, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanspark.functions.signals import first_argmax, softmax
from gleanspark.storage import materialize

# Up to this size a model is sent to every executor, and of a larger one the most frequent words. It
# bounds what each prediction collects on the driver, whatever the vocabulary.
BROADCAST_BYTES = 8 << 20
# A word with over one in so many occurrences would fill a task.
HOT_WORDS = 1000
# Copies of such a word where it is not sent out, so that it spreads over many tasks.
SALTS = 64
# Scores are compared at this many places, so a prediction does not hang on summing order.
TIE_PLACES = 10


@dataclass(frozen=True)
class BayesModel:
    counts: DataFrame
    doc_counts: tuple[int, ...]
    word_counts: tuple[int, ...]
    vocabulary: int
    size_bytes: int
    # Bytes of the words by step of frequency, most frequent first.
    step_bytes: tuple[tuple[int, int], ...]

    @property
    def num_classes(self) -> int:
        return len(self.doc_counts)

    def predict(self, docs: DataFrame, id_col: str, carry: Sequence[str] = ()) -> DataFrame:
        return predict(docs, self, id_col, carry)

    def priors(self) -> list[float]:
        """Smoothed log share of each class, defined for a class never seen too."""
        total = sum(self.doc_counts) + self.num_classes
        return [log((n + 1) / total) for n in self.doc_counts]

    def head_step(self, most_bytes: int) -> int:
        """The least step of frequency whose words, with all more frequent ones, take ``most_bytes``."""
        least, size = self.step_bytes[0][0] + 1 if self.step_bytes else 0, 0
        for step, more in self.step_bytes:
            size += more
            if size > most_bytes:
                break
            least = step
        return least

    def weights(self, where: str = "true") -> DataFrame:
        """Log likelihood of each known word in each class; ``where`` may name ``step``."""
        step = frequency_step(self.num_classes)
        return self.counts.filter("token IS NOT NULL").withColumn("step", step).filter(where).selectExpr(
            "token",
            *[
                f"ln((n_{c} + 1) / {float(total + self.vocabulary)!r}D) AS w_{c}"
                for c, total in enumerate(self.word_counts)
            ],
        )


def frequency_step(num_classes: int) -> Column:
    """Frequency of a word in sixteenths of a power of two, of which there are a few hundred."""
    return F.expr(f"int(floor(log2({' + '.join(f'n_{c}' for c in range(num_classes))}) * 16))")


def word_counts(docs: DataFrame, num_classes: int) -> DataFrame:
    """Counts per (word, class) of ``docs(label, tokens)``, plus the NULL row."""
    checked = (
        f"CASE WHEN label BETWEEN 0 AND {num_classes - 1} THEN label "
        f"ELSE int(raise_error('label outside 0..{num_classes - 1}')) END AS label"
    )
    return (
        docs.selectExpr(checked, "explode(concat(tokens, array(string(NULL)))) AS token")
        .groupBy("token")
        .agg(*[F.expr(f"count_if(label = {c}) AS n_{c}") for c in range(num_classes)])
    )


def add_counts(*tables: DataFrame) -> DataFrame:
    """Counts of the joined training sets, from the counts of each."""
    union = tables[0]
    for table in tables[1:]:
        union = union.unionByName(table)
    columns = [c for c in union.columns if c != "token"]
    return union.groupBy("token").agg(*[F.expr(f"sum({c}) AS {c}") for c in columns])


def model_of(counts: DataFrame) -> BayesModel:
    """Wrap a written count table; reads a row of totals for each step of frequency."""
    classes = sum(c.startswith("n_") for c in counts.columns)
    step = F.when(F.col("token").isNotNull(), frequency_step(classes))
    rows = counts.groupBy(step.alias("step")).agg(
        F.count("token").alias("vocabulary"),
        F.coalesce(F.sum(F.expr(f"octet_length(token) + {8 * classes}")), F.lit(0)).alias("size_bytes"),
        *[F.sum(f"n_{c}").alias(f"n_{c}") for c in range(classes)],
    ).collect()
    words = sorted((r for r in rows if r["step"] is not None), key=lambda r: -r["step"])
    texts = [r for r in rows if r["step"] is None]
    return BayesModel(
        counts=counts,
        doc_counts=tuple(sum(r[f"n_{c}"] for r in texts) for c in range(classes)),
        word_counts=tuple(sum(r[f"n_{c}"] for r in words) for c in range(classes)),
        vocabulary=sum(r["vocabulary"] for r in words),
        size_bytes=sum(r["size_bytes"] for r in words),
        step_bytes=tuple((r["step"], r["size_bytes"]) for r in words),
    )


def fit(docs: DataFrame, num_classes: int) -> BayesModel:
    """Fit on ``docs(label, tokens)``; the classes come from ``num_classes``, not the rows."""
    return model_of(materialize(word_counts(docs, num_classes), "model"))


def with_weights(
    words: DataFrame, id_col: str, model: BayesModel, broadcast_bytes: int, salts: int
) -> DataFrame:
    """Join ``words(id, token, _place, …)`` to the model; unknown words keep NULL weights.

    Of a large model the most frequent words, most of a text, are joined where they are. Only rare
    words are shuffled: those the model knows come as rows of their own, with a ``_place`` that begins
    no text.
    """
    if model.size_bytes <= broadcast_bytes:
        return words.join(F.broadcast(model.weights()), "token", "left")
    least = model.head_step(broadcast_bytes)
    head = model.weights(f"step >= {least}")
    tail = model.weights(f"step < {least}")
    rare = words.select(id_col, "token").join(F.broadcast(head.select("token")), "token", "left_anti")
    hot = int(log2(max(1, sum(model.word_counts) / HOT_WORDS)) * 16)
    on = ["token"]
    if hot < least:
        # The limit leaves frequent words to the shuffle.
        frequent = model.weights(f"step BETWEEN {hot} AND {least - 1}").select("token", F.lit(True).alias("_hot"))
        copies = F.sequence(F.lit(0), F.when(F.col("_hot"), salts - 1).otherwise(0))
        salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(id_col), F.lit(salts)).cast("int")).otherwise(0)
        marked = lambda rows: rows.join(F.broadcast(frequent), "token", "left")
        rare = marked(rare).withColumn("_salt", salt).drop("_hot")
        tail = marked(tail).withColumn("_salt", F.explode(copies)).drop("_hot")
        on = ["token", "_salt"]
    # Without the hint a model just over the limit could be broadcast after all.
    met = rare.join(tail.hint("merge"), on).drop("_salt").withColumn("_place", F.lit(1))
    return words.join(F.broadcast(head), "token", "left").unionByName(met, allowMissingColumns=True)


def class_scores(
    docs: DataFrame,
    model: BayesModel,
    id_col: str,
    carry: Sequence[str] = (),
    broadcast_bytes: int = BROADCAST_BYTES,
    salts: int = SALTS,
) -> DataFrame:
    """Scores ``z_0 … z_{C-1}`` of ``docs(id, tokens)``, one row per document.

    ``carry`` names further columns of fixed width to keep. The likelihood is divided by the
    number of known words, which keeps the probabilities from saturating; a document with no
    known word is scored by the priors. An id that several documents share is an error.
    """
    words = docs.select(id_col, *carry, F.posexplode_outer("tokens").alias("_place", "token"))
    priors = model.priors()
    classes = range(model.num_classes)
    summed = (
        with_weights(words, id_col, model, broadcast_bytes, salts)
        .groupBy(id_col)
        .agg(
            *[F.max(c).alias(c) for c in carry],
            F.count_if(F.coalesce("_place", F.lit(0)) == 0).alias("_docs"),
            F.count("w_0").alias("_known"),
            *[F.expr(f"sum(w_{c}) AS _w_{c}") for c in classes],
        )
    )
    merged = "bigint(raise_error('several documents have the same id'))"
    checked = summed.withColumn("_known", F.expr(f"IF(_docs = 1, _known, {merged})"))
    return checked.selectExpr(
        id_col,
        *carry,
        *[f"{priors[c]!r}D + IF(_known > 0, _w_{c} / _known, 0D) AS z_{c}" for c in classes],
    )


def probabilities(scored: DataFrame) -> DataFrame:
    """Replace the scores by ``probs`` (index = class) and ``prediction``."""
    scores = [c for c in scored.columns if c.startswith("z_")]
    rounded = f"array({', '.join(f'round({z}, {TIE_PLACES})' for z in scores)})"
    return scored.select(
        *[c for c in scored.columns if c not in scores],
        F.array(*softmax(scores)).alias("probs"),
        first_argmax(rounded).alias("prediction"),
    )


def predict(
    docs: DataFrame, model: BayesModel, id_col: str, carry: Sequence[str] = (), **options
) -> DataFrame:
    """Class probabilities and prediction for ``docs(id, tokens)``."""
    return probabilities(class_scores(docs, model, id_col, carry, **options))


def mean_loss(predicted: DataFrame) -> Column:
    """Aggregate: mean cross-entropy of ``predicted(label, probs)``."""
    return F.avg(-F.ln(F.get(F.col("probs"), F.col("label"))))
