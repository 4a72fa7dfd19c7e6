"""The scoring path: from a text and its claimed label to the context of the policy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanspark.config import SelectionConfig
from gleanspark.functions import signals
from gleanspark.functions.text import tokens
from gleanspark.operators.embedding import hashed_vector
from gleanspark.operators.learner import Model
from gleanspark.operators.novelty import TrustedSet


def with_tokens(texts: DataFrame, config: SelectionConfig) -> DataFrame:
    return texts.withColumn("tokens", tokens(F.col("text"), config.max_tokens))


def with_vectors(tokenised: DataFrame, config: SelectionConfig) -> DataFrame:
    """Add hashed word counts as ``vector``; a table that brings vectors of its own keeps them."""
    if "vector" in tokenised.columns:
        return tokenised
    return tokenised.withColumn("vector", hashed_vector(F.col("tokens"), config.embedding_dim))


def trusted_set(tokenised: DataFrame, config: SelectionConfig, **options) -> TrustedSet:
    """The trusted rows ``(id, tokens[, vector])`` candidates are compared with."""
    return TrustedSet(with_vectors(tokenised, config), "id", "vector", **options)


def with_novelty(
    candidates: DataFrame, trusted: TrustedSet, config: SelectionConfig
) -> DataFrame:
    """Add ``novelty`` to ``candidates(cand_id, tokens, …)``. It never depends on the model."""
    scored = trusted.score(with_vectors(candidates, config), "vector")
    return scored.drop("vector")


def with_signals(candidates: DataFrame, model: Model, carry: tuple[str, ...] = ()) -> DataFrame:
    """Signals and context weight of ``candidates(cand_id, label, novelty, tokens)``."""
    predicted = model.predict(candidates, "cand_id", ("label", "novelty", *carry))
    return predicted.select(
        "*",
        signals.uncertainty().alias("uncertainty"),
        signals.verifier_confidence().alias("verifier"),
    ).select(
        "*", signals.context().alias("context"), signals.context_weight().alias("weight")
    )


def score_candidates(
    candidates: DataFrame,
    model: Model,
    trusted: TrustedSet,
    config: SelectionConfig,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Score ``candidates(cand_id, text, label)`` in one chain with a single narrow shuffle."""
    ready = with_novelty(with_tokens(candidates, config), trusted, config)
    return with_signals(ready, model, carry)
