"""Accept-or-reject policies as column expressions.

Inside one batch the state does not change, so a whole batch is decided in one projection.
The state may come from literals (one round) or from columns (replay of many rounds).
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable, Mapping, Sequence
from math import pi

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanspark.config import EPSILON, SEED, UCB_ALPHA
from gleanspark.functions.hashing import positive_uniform
from gleanspark.functions.vectors import dot
from gleanspark.operators.rewards import ARMS, STATE_COLUMNS, all_tallies, arm_states

# Up to this shape a Gamma draw is a sum of exponential draws, beyond it a draw by rejection.
SUMMED_SHAPE = 64
# A try is rejected in under one of twenty cases; after so many the exact sum is taken.
TRIES = 8


def gamma_sum(seed: int, tag: str, shape: Column, row_id: Column) -> Column:
    """A Gamma draw of whole ``shape`` as the sum of so many exponential draws."""
    draws = F.transform(
        F.sequence(F.lit(1).cast("bigint"), shape.cast("bigint")),
        lambda i: -F.ln(positive_uniform(seed, tag, row_id, i)),
    )
    return F.aggregate(draws, F.lit(0.0), lambda total, x: total + x)


def gamma_by_rejection(seed: int, tag: str, shape: Column, row_id: Column) -> Column:
    """A Gamma draw by the method of Marsaglia and Tsang, at a cost that does not grow with ``shape``.

    The tries have numbered draws of their own and each is made only if the ones before were
    rejected, so the draw depends on the row alone. NULL if all ``TRIES`` were rejected.
    """
    d = shape - F.lit(1 / 3)
    c = F.lit(1.0) / F.sqrt(F.lit(9.0) * d)

    def tried(i: Column) -> Column:
        u = lambda name: positive_uniform(seed, f"{tag}:{name}", row_id, i)
        normal = F.sqrt(F.lit(-2.0) * F.ln(u("radius"))) * F.cos(F.lit(2 * pi) * u("angle"))
        # One-element arrays, so that each value is worked out once.
        shifted = F.transform(F.array(normal), lambda x: F.struct(x.alias("x"), (F.lit(1.0) + c * x).alias("s")))
        cubed = F.transform(shifted, lambda p: F.struct(p["x"].alias("x"), (p["s"] * p["s"] * p["s"]).alias("v")))
        bar = lambda p: F.lit(0.5) * p["x"] * p["x"] + d - d * p["v"] + d * F.ln(p["v"])
        drawn = F.transform(cubed, lambda p: F.when((p["v"] > 0) & (F.ln(u("bar")) < bar(p)), d * p["v"]))
        return F.get(drawn, F.lit(0))

    numbers = F.sequence(F.lit(1).cast("bigint"), F.lit(TRIES).cast("bigint"))
    none = F.lit(None).cast("double")
    return F.aggregate(numbers, none, lambda found, i: F.when(found.isNotNull(), found).otherwise(tried(i)))


def gamma(seed: int, tag: str, shape: Column, row_id: Column) -> Column:
    """A draw from Gamma(shape, 1) for a whole shape, keyed by the row id."""
    exact = gamma_sum(seed, tag, shape, row_id)
    drawn = F.coalesce(gamma_by_rejection(seed, tag, shape, row_id), exact)
    return F.when(shape <= SUMMED_SHAPE, exact).otherwise(drawn)


class Policy(ABC):
    """A rule that turns state, clock, context weight and row id into 0 or 1.

    Own policies implement :meth:`arm_scores`, and where they differ :meth:`boosted` or
    :meth:`choose`. The state may be the policy's own: sums over the reward log (:meth:`tallies`)
    and what is made of them (:meth:`finish`), named by ``state``. The sums add up along the
    log, so a round needs one aggregate and a replay one running sum. A policy that
    ``reads_context`` finds the row's context vector in the state as well.
    """

    state: Sequence[str] = STATE_COLUMNS
    reads_context = False

    def tallies(self) -> dict[str, Column]:
        """What a row of the log ``(arm, reward, context)`` adds to each sum; 0 if there is none."""
        return all_tallies()

    def finish(self) -> list[Column]:
        """The columns ``state``, from the sums."""
        return arm_states()

    @abstractmethod
    def arm_scores(
        self, state: Mapping[str, Column], t: Column, row_id: Column
    ) -> tuple[Column, Column]:
        """Scores of reject and accept before the context is looked at."""

    def boosted(
        self, state: Mapping[str, Column], t: Column, weight: Column, row_id: Column
    ) -> tuple[Column, Column]:
        """Scores with the accept arm scaled by the context weight."""
        reject, accept = self.arm_scores(state, t, row_id)
        return reject, accept * (F.lit(1.0) + weight)

    def action(
        self, state: Mapping[str, Column], t: Column, weight: Column, row_id: Column
    ) -> Column:
        return self.choose(t, *self.boosted(state, t, weight, row_id))

    def choose(self, t: Column, reject: Column, accept: Column) -> Column:
        """1 to accept, from the boosted scores; a tie rejects."""
        return F.when(accept > reject, 1).otherwise(0)


class UpperConfidence(Policy):
    """Mean reward plus a bonus for rarely pulled arms; the first two rows try both arms."""

    def __init__(self, alpha: float = UCB_ALPHA):
        self.alpha = alpha

    def arm_scores(self, state, t, row_id):
        def score(arm: int) -> Column:
            seen = state[f"pulls_{arm}"] + F.lit(EPSILON)
            return state[f"mean_{arm}"] + F.lit(self.alpha) * F.sqrt(F.ln(t) / seen)

        return score(0), score(1)

    def choose(self, t, reject, accept):
        opening = (t - 1).cast("int")
        return F.when(t <= len(ARMS), opening).otherwise(super().choose(t, reject, accept))


class PosteriorSampling(Policy):
    """A draw from each arm's Beta posterior, keyed by row id.

    A Beta draw is G_a / (G_a + G_b) with G_k a Gamma draw of shape k, which is a whole number. What a
    row costs does not grow with the rounds played.
    """

    def __init__(self, seed: int = SEED):
        self.seed = seed

    def arm_scores(self, state, t, row_id):
        def draw(arm: int) -> Column:
            won = gamma(self.seed, f"alpha{arm}", state[f"alpha_{arm}"], row_id)
            lost = gamma(self.seed, f"beta{arm}", state[f"beta_{arm}"], row_id)
            return won / (won + lost)

        return draw(0), draw(1)


class LinearConfidence(Policy):
    """Linear regression of the reward on the context, per arm, plus a bonus for contexts rarely seen.

    The state of an arm is its own: the sums of x x' and of reward times x over its rounds. They are
    solved once per state, not per row. A round without a context adds nothing.
    """

    state = tuple(f"{name}_{arm}" for arm in ARMS for name in ("theta", "inverse"))
    reads_context = True

    def __init__(self, dim: int = 3, alpha: float = UCB_ALPHA, ridge: float = 1.0):
        self.dim, self.alpha, self.ridge = dim, alpha, ridge

    def _names(self, arm: int) -> tuple[list[str], list[str]]:
        places = range(self.dim)
        return [f"_xx_{arm}_{i}_{j}" for i in places for j in places if i <= j], [f"_rx_{arm}_{i}" for i in places]

    def tallies(self):
        sums = {}
        for arm in ARMS:
            squares, products = self._names(arm)
            pairs = [(i, j) for i in range(self.dim) for j in range(self.dim) if i <= j]
            terms = [f"get(context, {i}) * get(context, {j})" for i, j in pairs]
            terms += [f"double(reward) * get(context, {i})" for i in range(self.dim)]
            for name, term in zip(squares + products, terms):
                sums[name] = F.expr(f"IF(arm = {arm}, coalesce({term}, 0D), 0D)")
        return sums

    def finish(self):
        dim, ridge = self.dim, self.ridge
        upper = np.triu_indices(dim)

        @F.arrow_udf("struct<theta: array<double>, inverse: array<double>>")
        def solved(squares: pa.Array, products: pa.Array) -> pa.Array:
            theta, inverse = [], []
            for xx, rx in zip(squares.to_pylist(), products.to_pylist()):
                matrix = np.zeros((dim, dim))
                matrix[upper] = xx
                matrix = matrix + np.triu(matrix, 1).T + ridge * np.eye(dim)
                inverse.append(np.linalg.inv(matrix).ravel())
                theta.append(np.linalg.solve(matrix, np.array(rx)))
            lists = pa.list_(pa.float64())
            return pa.StructArray.from_arrays([pa.array(theta, lists), pa.array(inverse, lists)], ["theta", "inverse"])

        out = []
        for arm in ARMS:
            squares, products = self._names(arm)
            found = solved(F.array(*squares), F.array(*products))
            out += [found[name].alias(f"{name}_{arm}") for name in ("theta", "inverse")]
        return out

    def arm_scores(self, state, t, row_id):
        x = state["context"]

        def score(arm: int) -> Column:
            place = lambda k: F.get(x, k.cast("int"))
            term = lambda a, k: a * place(F.floor(k / self.dim)) * place(k % self.dim)
            spread = F.aggregate(F.transform(state[f"inverse_{arm}"], term), F.lit(0.0), lambda s, v: s + v)
            return dot(state[f"theta_{arm}"], x) + F.lit(self.alpha) * F.sqrt(F.greatest(spread, F.lit(0.0)))

        return score(0), score(1)

    def boosted(self, state, t, weight, row_id):
        """The context is in the scores already."""
        return self.arm_scores(state, t, row_id)


POLICIES: dict[str, Callable[..., Policy]] = {
    "ucb": UpperConfidence,
    "thompson": PosteriorSampling,
    "linear": LinearConfidence,
}


def make_policy(name: str, **options) -> Policy:
    if name not in POLICIES:
        raise ValueError(f"unknown policy {name!r}; known are {sorted(POLICIES)}")
    return POLICIES[name](**options)


def state_columns(policy: Policy | None = None) -> dict[str, Column]:
    """The state as columns of the row at hand, with the row's context if the policy reads it."""
    names = STATE_COLUMNS if policy is None else policy.state
    return {name: F.col(name) for name in names} | _context(policy)


def state_literals(state: Mapping[str, float], policy: Policy | None = None) -> dict[str, Column]:
    """The state of one round as constants."""
    names = STATE_COLUMNS if policy is None else policy.state
    return {name: F.lit(state[name]) for name in names} | _context(policy)


def _context(policy: Policy | None) -> dict[str, Column]:
    return {"context": F.col("context")} if policy is not None and policy.reads_context else {}
