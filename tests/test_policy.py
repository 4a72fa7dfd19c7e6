from math import log, sqrt
from math import log as ln

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanspark.config import SelectionConfig
from gleanspark.operators import policy as policies
from gleanspark.operators import rewards
from gleanspark.plans import replay as replays
from gleanspark.plans.loop import SelectionRun, policy_of
from gleanspark.plans.replay import replay

STATE = "pulls_0 bigint, mean_0 double, pulls_1 bigint, mean_1 double, t bigint, w double, id bigint"


def decide(spark, policy, rows):
    args = policies.state_columns(), F.col("t"), F.col("w"), F.col("id")
    state = {k: args[0][k] for k in ("pulls_0", "mean_0", "pulls_1", "mean_1")}
    args = (state, *args[1:])
    df = spark.createDataFrame(rows, STATE)
    return [tuple(r) for r in df.select(*policy.boosted(*args), policy.action(*args)).collect()]


@pytest.mark.parametrize(
    "mean, count, t, w, accept, reject, action",
    [
        ((0.0, 0.0), (0, 0), 3, 0.4, 46403.449072, 33145.320766, 1),
        ((0.0, 0.0), (0, 0), 3, 0.0, 33145.320766, 33145.320766, 0),
        ((0.0, 0.1), (0, 1), 51, 0.4, 2.916036, 62704.271248, 0),
        ((0.02, 0.1), (1, 1), 101, 0.4, 3.147596, 2.168283, 1),
        ((0.02, 0.1), (1, 2), 151, 0.3, 2.189029, 2.259929, 0),
        ((0.02, 0.1), (1, 2), 151, 0.5, 2.525803, 2.259929, 1),
        ((0.0, -3.0), (1, 1), 101, 0.5, -1.277575, 2.148283, 0),
    ],
)
def test_ucb_scores(spark, mean, count, t, w, accept, reject, action):
    [row] = decide(spark, policies.UpperConfidence(), [(count[0], mean[0], count[1], mean[1], t, w, 0)])
    assert row == (pytest.approx(reject, abs=1e-6), pytest.approx(accept, abs=1e-6), action)


def test_ucb_tries_both_arms_first(spark):
    rows = [(9, 5.0, 1, -5.0, 1, 0.9, 0), (9, 5.0, 1, -5.0, 2, 0.0, 0)]
    assert [r[2] for r in decide(spark, policies.UpperConfidence(), rows)] == [0, 1]


LOG = [(1, 1, 0.05), (2, 0, -0.01), (3, 1, 0.02), (4, 1, -0.03), (5, 0, 0.0)]
LOG_SCHEMA = "iteration int, arm int, reward double"


def test_running_state(spark):
    log = spark.createDataFrame(LOG, LOG_SCHEMA)
    states = replays.state_before(log.selectExpr("iteration AS batch_no"), log).orderBy("batch_no")
    found = [(r["pulls_1"], r["mean_1"], r["alpha_1"], r["beta_1"]) for r in states.collect()]
    expected = [(0, 0, 1, 1), (1, 0.05, 2, 1), (1, 0.05, 2, 1), (2, 0.035, 3, 1), (3, 0.0133333333, 3, 2)]
    assert found == [pytest.approx(e, abs=1e-9) for e in expected]


def test_final_state_by_arm(spark):
    found = rewards.state_by_arm(spark.createDataFrame(LOG, LOG_SCHEMA)).orderBy("arm").collect()
    # A reward of exactly 0 counts as a failure.
    assert [tuple(r)[1:] for r in found] == [
        (2, pytest.approx(-0.005), 1, 3),
        (3, pytest.approx(0.04 / 3), 3, 2),
    ]


def test_state_of_an_empty_log(spark):
    row = rewards.state_wide(spark.createDataFrame([], LOG_SCHEMA)).first().asDict()
    assert row == {f"{k}_{a}": v for a in (0, 1) for k, v in
                   {"pulls": 0, "mean": 0.0, "alpha": 1, "beta": 1}.items()}


def sequential_ucb(candidates, log, alpha):
    """The rule row by row, with the state updated after every batch."""
    counts, means, t, actions = [0, 0], [0.0, 0.0], 0, []
    for iteration, arm, reward in log:
        for _, batch_no, w in candidates:
            if batch_no != iteration:
                continue
            t += 1
            if t <= 2:
                actions.append(t - 1)
                continue
            scores = [means[k] + alpha * sqrt(log_(t) / (counts[k] + 1e-9)) for k in (0, 1)]
            scores[1] *= 1 + w
            actions.append(1 if scores[1] > scores[0] else 0)
        counts[arm] += 1
        means[arm] += (reward - means[arm]) / counts[arm]
    return actions


log_ = log


def test_replay_equals_the_sequential_rule(spark):
    rows = [(i + 1, i // 30 + 1, (i * 37 % 101) / 101) for i in range(150)]
    candidates = spark.createDataFrame(
        [(t, t, b, w) for t, b, w in rows], "cand_id bigint, t bigint, batch_no int, weight double"
    )
    log = spark.createDataFrame(LOG, LOG_SCHEMA)
    found = replay(candidates, log, policies.UpperConfidence(0.7)).orderBy("t").collect()
    assert [r["action"] for r in found] == sequential_ucb(rows, LOG, 0.7)


def test_open_batches_take_the_last_known_state(spark):
    schema = "cand_id bigint, t bigint, batch_no int, weight double"
    rows = [(1, 40, 1, 0.5), (2, 50, 4, 0.5), (3, 50, 9, 0.5), (4, 50, 20, 0.5)]
    log = spark.createDataFrame([r for r in LOG if r[0] <= 3], LOG_SCHEMA)
    found = replay(spark.createDataFrame(rows, schema), log, policies.UpperConfidence())
    scores = {r["cand_id"]: (r["reject_score"], r["accept_score"]) for r in found.collect()}
    assert set(scores) == {1, 2, 3, 4}
    assert scores[2] == scores[3] == scores[4] != scores[1]


@pytest.mark.parametrize("a, b", [(1, 1), (3, 2), (8, 14)])
def test_beta_draws_have_the_right_moments(spark, a, b):
    state = {f"{p}_{arm}": F.lit(v) for arm in (0, 1) for p, v in (("alpha", a), ("beta", b))}
    reject, accept = policies.PosteriorSampling(1).arm_scores(state, F.lit(1), F.col("id"))
    row = spark.range(20_000).agg(
        F.avg(reject), F.var_samp(reject), F.avg(accept), F.var_samp(accept), F.corr(reject, accept)
    ).first()
    mean, variance = a / (a + b), a * b / ((a + b) ** 2 * (a + b + 1))
    assert row[0] == pytest.approx(mean, abs=0.01) and row[2] == pytest.approx(mean, abs=0.01)
    assert row[1] == pytest.approx(variance, rel=0.05) and row[3] == pytest.approx(variance, rel=0.05)
    assert abs(row[4]) < 0.03


@pytest.mark.parametrize("w, share", [(0.0, 0.5), (0.5, 0.6667), (1.0, 0.75)])
def test_thompson_acceptance_share(spark, w, share):
    state = {f"{p}_{arm}": F.lit(1) for arm in (0, 1) for p in ("alpha", "beta")}
    action = policies.PosteriorSampling(1).action(state, F.lit(1), F.lit(w), F.col("id"))
    assert spark.range(20_000).agg(F.avg(action)).first()[0] == pytest.approx(share, abs=0.012)


def test_policies_by_name():
    assert policies.make_policy("ucb", alpha=2.0).alpha == 2.0
    assert isinstance(policies.make_policy("thompson"), policies.PosteriorSampling)
    assert policy_of(SelectionConfig(ucb_alpha=0.5)).alpha == 0.5
    with pytest.raises(ValueError, match="unknown policy 'greedy'"):
        policies.make_policy("greedy")


@pytest.mark.parametrize("shape", [1, 2, 10, 64, 65, 1000, 1_000_000])
def test_moments_of_gamma_draws(spark, shape):
    """Mean and variance are the shape; by sums up to a limit, by rejection at any shape."""
    shaped = F.lit(shape).cast("bigint")
    drawn = policies.gamma_by_rejection(42, "moments", shaped, F.col("id"))
    rows = spark.range(40_000).select(
        drawn.alias("x"), policies.gamma(42, "moments", shaped, F.col("id")).alias("y")
    ).agg(*[f(c).alias(f"{f.__name__}_{c}") for c in "xy" for f in (F.avg, F.variance, F.count, F.skewness)]).first()
    for c in "xy":
        assert rows[f"count_{c}"] == 40_000
        assert rows[f"avg_{c}"] == pytest.approx(shape, abs=4 * sqrt(shape / 40_000))
        assert rows[f"variance_{c}"] == pytest.approx(shape, rel=0.05)
        assert rows[f"skewness_{c}"] == pytest.approx(2 / sqrt(shape), abs=0.25)


def test_gamma_draws_take_sums_up_to_the_limit(spark):
    small, large = F.lit(policies.SUMMED_SHAPE), F.lit(policies.SUMMED_SHAPE + 1)
    draws = [policies.gamma(1, "g", small, F.col("id")), policies.gamma_sum(1, "g", small, F.col("id")),
             policies.gamma(1, "g", large, F.col("id")), policies.gamma_by_rejection(1, "g", large, F.col("id"))]
    for a, b, c, d in spark.range(50).select(*draws).collect():
        assert a == b and c == d


def plain_linear(log, batch, x, alpha=1.0):
    """(reject, accept) of one context after the rounds before a batch."""
    out = []
    for arm in (0, 1):
        matrix, vector = np.eye(len(x)), np.zeros(len(x))
        for iteration, a, reward, context in log:
            if a == arm and iteration < batch and context is not None:
                matrix, vector = matrix + np.outer(context, context), vector + reward * np.array(context)
        out.append(np.linalg.solve(matrix, vector) @ x + alpha * sqrt(x @ np.linalg.inv(matrix) @ x))
    return out


def test_linear_policy_carries_its_own_sums(spark):
    rng = np.random.default_rng(23)
    log = [(k, int(rng.integers(2)), float(rng.normal()), rng.random(4).tolist() if k % 5 else None) for k in range(1, 60)]
    cands = [(i, i + 1, int(rng.integers(1, 70)), 0.5, rng.random(4).tolist()) for i in range(80)]
    rounds = spark.createDataFrame(log, "iteration int, arm int, reward double, context array<double>").repartition(5)
    rows = spark.createDataFrame(cands, "cand_id bigint, t bigint, batch_no int, weight double, context array<double>")
    found = replay(rows, rounds, policies.make_policy("linear", dim=4)).collect()
    assert len(found) == len(cands)
    for r in found:
        reject, accept = plain_linear(log, r["batch_no"], np.array(r["context"]))
        assert (r["reject_score"], r["accept_score"]) == (pytest.approx(reject), pytest.approx(accept))
        assert r["action"] == int(accept > reject)


def test_many_runs_are_decided_by_their_own_rounds(spark):
    """One run holds most rounds, one has none, one has no name."""
    rng = np.random.default_rng(29)
    names = ["big"] * 300 + ["small"] * 5 + [None] * 9
    counts, log = {}, []
    for name in names:
        counts[name] = counts.get(name, 0) + 1
        log.append((name, counts[name], int(rng.integers(2)), float(rng.normal())))
    cands = [(name, i, i + 1, b, 0.25) for i, (name, b) in enumerate(
        (n, b) for n in ("big", "small", None, "new") for b in (1, 2, 6, 200, 301))]
    rounds = spark.createDataFrame(log, "run string, iteration int, arm int, reward double").repartition(7)
    rows = spark.createDataFrame(cands, "run string, cand_id bigint, t bigint, batch_no int, weight double")
    found = {r["cand_id"]: r for r in replay(rows, rounds, policies.UpperConfidence(), ["run"]).collect()}
    assert len(found) == len(cands)
    for name, i, t, batch, weight in cands:
        seen = [[r for n, k, a, r in log if n == name and k < batch and a == arm] for arm in (0, 1)]
        mean = [sum(s) / len(s) if s else 0.0 for s in seen]
        scores = [m + sqrt(ln(t) / (len(s) + 1e-9)) for m, s in zip(mean, seen)]
        assert found[i]["reject_score"] == pytest.approx(scores[0])
        assert found[i]["accept_score"] == pytest.approx(scores[1] * (1 + weight))
        assert found[i]["run"] == name


def test_loop_with_a_policy_that_has_its_own_state(spark):
    from tests.test_loop import CONFIG, POOL, REAL

    real = spark.createDataFrame(REAL, "id bigint, text string, label int, split string")
    pool = spark.createDataFrame(POOL, "cand_id bigint, text string, label int")
    run = SelectionRun(spark, real, CONFIG, policy=policies.make_policy("linear")).run(pool)
    rounds = run.rounds.filter("iteration > 0").orderBy("iteration").collect()
    played = [(r["iteration"], r["arm"], r["reward"], r["context"]) for r in rounds]
    assert len(played) > 2 and all(len(c) == 3 for *_, c in played)
    for r in run.decisions.collect():
        x = np.array([r["uncertainty"], r["novelty"], r["verifier"]])
        reject, accept = plain_linear(played, r["iteration"], x)
        if abs(accept - reject) > 1e-9:
            assert r["action"] == int(accept > reject)
    for iteration, arm, _, context in played:
        rows = [r for r in run.decisions.collect() if r["iteration"] == iteration and r["action"] == arm]
        assert context == [pytest.approx(np.mean([r[c] for r in rows])) for c in ("uncertainty", "novelty", "verifier")]
