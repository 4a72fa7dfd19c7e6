"""Recompute every decision of a run from its reward log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanspark.operators.policy import Policy, state_columns
from gleanspark.operators.prefix import in_segments, running
from gleanspark.operators.rewards import all_tallies, arm_states
from gleanspark.storage import materialize


def state_before(
    batches: DataFrame, log: DataFrame, policy: Policy | None = None, keys: Sequence[str] = ()
) -> DataFrame:
    """``*keys, batch_no`` and the state after all rounds of the run's log before that batch.

    The batches are put among the rounds as rows that add nothing, so a log of any length is
    worked on in segments, and a batch without a round of its own has a state as well. ``keys`` name
    the run, if the tables hold many; one that has most of the rounds is cut like any other. The
    state is that of ``policy``, or that of the built-in ones.
    """
    tallies = all_tallies() if policy is None else policy.tallies()
    finish = arm_states() if policy is None else policy.finish()
    context = [c for c in log.columns if c == "context"]
    rounds = log.select(*keys, F.col("iteration").cast("bigint").alias("iteration"), "arm", "reward", *context)
    asked = batches.select(*keys, F.col("batch_no").cast("bigint").alias("iteration")).distinct()
    marked = rounds.withColumn("played", F.lit(1)).unionByName(
        asked.withColumn("played", F.lit(0)), allowMissingColumns=True
    )
    order = ["iteration", "played"]
    summed = running(in_segments(marked, keys, order), keys, order, sums=tallies)
    states = summed.filter("played = 0").withColumnRenamed("iteration", "batch_no")
    return states.select(*keys, "batch_no", *finish)


def replay(candidates: DataFrame, log: DataFrame, policy: Policy, keys: Sequence[str] = ()) -> DataFrame:
    """Decide ``candidates(cand_id, t, batch_no, weight)`` from ``log(iteration, arm, reward)``.

    A batch is decided by the rounds before it, whether or not it has been played itself; a row
    without a batch number is left out. With ``keys`` both tables hold many runs, each decided by
    its own rounds; a run without any is decided by the first state, a row without a key belongs to the
    run without one. A policy that reads contexts finds the column ``context`` in both tables.
    """
    candidates = materialize(candidates.filter("batch_no IS NOT NULL"), "candidates")
    states = materialize(state_before(candidates, log, policy, keys), "states")
    same = candidates["batch_no"] == states["batch_no"]
    for key in keys:
        same = same & candidates[key].eqNullSafe(states[key])
    joined = candidates.join(states.select("*"), same).drop(*[states[c] for c in ("batch_no", *keys)])
    args = state_columns(policy), F.col("t"), F.col("weight"), F.col("cand_id")
    reject, accept = policy.boosted(*args)
    scores = joined.select(
        *candidates.columns, reject.alias("reject_score"), accept.alias("accept_score")
    )
    action = policy.choose(F.col("t"), F.col("reject_score"), F.col("accept_score"))
    return scores.withColumn("action", action)
