"""The reward log and the policy state folded from it.

A log has a row per round: ``iteration``, ``arm`` (0 reject, 1 accept) and ``reward``. A table
may hold the logs of many runs, told apart by key columns.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanspark.operators.prefix import running

ARMS = (0, 1)
STATE = ("pulls", "mean", "alpha", "beta")
STATE_COLUMNS = tuple(f"{name}_{arm}" for arm in ARMS for name in STATE)


def _tallies(arm: int) -> dict[str, Column]:
    """What has to be summed over a log to know the state of ``arm``."""
    return {
        f"_n_{arm}": F.expr(f"IF(arm = {arm}, 1L, 0L)"),
        f"_sum_{arm}": F.expr(f"IF(arm = {arm}, reward, 0)"),
        f"_won_{arm}": F.expr(f"IF(arm = {arm} AND reward > 0, 1L, 0L)"),
    }


def arm_state(arm: int) -> list[Column]:
    """Pulls, mean reward, and the two Beta parameters, from the sums of :func:`_tallies`."""
    n, total, won = f"_n_{arm}", f"_sum_{arm}", f"_won_{arm}"
    mean = f"IF({n} > 0, double({total}) / {n}, 0D)"
    return [
        F.expr(f"{expr} AS {name}_{arm}")
        for name, expr in zip(STATE, (n, mean, f"{won} + 1", f"{n} - {won} + 1"))
    ]


def all_tallies() -> dict[str, Column]:
    return {name: expr for arm in ARMS for name, expr in _tallies(arm).items()}


def arm_states() -> list[Column]:
    return [c for a in ARMS for c in arm_state(a)]


def folded(
    log: DataFrame, tallies: Mapping[str, Column], finish: Sequence[Column], keys: Sequence[str] = ()
) -> DataFrame:
    """``finish`` of the sums of ``tallies`` over the whole log: one row per run, also for an empty
    log without keys."""
    sums = [F.coalesce(F.sum(e), F.lit(0)).alias(n) for n, e in tallies.items()]
    return log.groupBy(*keys).agg(*sums).select(*keys, *finish)


def state_wide(log: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """State of the built-in policies after the whole log."""
    return folded(log, all_tallies(), arm_states(), keys)


def state_by_arm(log: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The same with a row per arm; an arm never pulled has 0 pulls, mean 0 and Beta(1, 1)."""
    arm_row = lambda arm: F.struct(
        F.lit(arm).alias("arm"), *[F.col(f"{name}_{arm}").alias(name) for name in STATE]
    )
    return state_wide(log, keys).select(*keys, F.inline(F.array(*[arm_row(a) for a in ARMS])))


def state_before_each(log: DataFrame, keys: Sequence[str]) -> DataFrame:
    """State before each row of a log written by ``prefix.in_segments``."""
    added = running(log, keys, ["iteration"], sums=all_tallies())
    return added.select(*log.columns, *[c for a in ARMS for c in arm_state(a)])


def reward_log(values: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rewards as steps of ``value`` along each run of a table from ``prefix.in_segments``.

    The first row of a run has nothing to be compared with, so a run of k+1 values gives k
    rewards; ``iteration`` counts the values before.
    """
    one = F.lit(1).cast("bigint")
    stepped = running(
        values, keys, order, sums={"iteration": one}, previous={"_before": F.col("value")}
    )
    kept = [c for c in values.columns if c not in ("value", "iteration")]
    return stepped.filter("iteration > 0").select(
        *kept, "iteration", (F.col("value") - F.col("_before")).alias("reward")
    )
