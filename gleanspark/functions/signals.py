"""Per-candidate signals as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanspark.config import EPSILON


def softmax(scores: list[str]) -> list[Column]:
    """Class probabilities from the columns named ``scores``."""
    top = f"greatest({', '.join(scores)})" if len(scores) > 1 else scores[0]
    total = " + ".join(f"exp({s} - {top})" for s in scores)
    return [F.expr(f"exp({s} - {top}) / ({total})") for s in scores]


def first_argmax(values: str) -> Column:
    """Zero-based place of the largest element of an array, the first one on ties."""
    return F.expr(f"CAST(array_position({values}, array_max({values})) - 1 AS INT)")


def uncertainty(probs: str = "probs") -> Column:
    """Entropy over its maximum, not clamped; one class has nothing to divide by."""
    entropy = f"-aggregate({probs}, 0D, (total, p) -> total + p * ln(p + {EPSILON!r}D))"
    return F.expr(f"IF(size({probs}) > 1, {entropy} / ln(size({probs})), {entropy})")


def verifier_confidence(probs: str = "probs", label: str = "label") -> Column:
    """Probability of the claimed label; a label outside the classes fails the job."""
    complaint = f"concat('label outside the classes: ', coalesce(string({label}), 'NULL'))"
    return F.expr(
        f"CASE WHEN {label} BETWEEN 0 AND size({probs}) - 1 THEN get({probs}, {label}) "
        f"ELSE double(raise_error({complaint})) END"
    )


def context() -> Column:
    """The context vector in its fixed order."""
    return F.array("uncertainty", "novelty", "verifier")


def context_weight() -> Column:
    """Mean of the context vector."""
    return F.expr("(uncertainty + novelty + verifier) / 3D")
