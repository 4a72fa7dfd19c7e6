import hashlib
import re
from collections import Counter
from math import exp, log, sqrt

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanspark.config import SelectionConfig
from gleanspark.operators.ordering import in_batches
from gleanspark.operators.policy import Policy
from gleanspark.plans.loop import SelectionRun
from gleanspark.streaming.arrivals import arriving_pool, play_arrivals, run_stream

CONFIG = SelectionConfig(num_classes=2, target_size=60, batch_size=30, max_rounds=6, embedding_dim=16)
GOOD, BAD = ["fine", "great", "lovely"], ["poor", "dull", "awful"]


def texts(n, seed):
    rng = np.random.default_rng(seed)
    for i in range(n):
        label = int(rng.integers(2))
        own, other = (GOOD, BAD) if label else (BAD, GOOD)
        words = list(rng.choice(own, 3)) + list(rng.choice(other, 2)) + [f"w{rng.integers(40)}"]
        yield i, " ".join(words), label


REAL = [(i, t, l, "train" if i < 8 else "val" if i < 60 else "test") for i, t, l in texts(120, 1)]
POOL = [(1000 + i, t, l if i % 6 else 1 - l) for i, t, l in texts(170, 2)]


@pytest.fixture(scope="module")
def real(spark):
    return spark.createDataFrame(REAL, "id bigint, text string, label int, split string")


@pytest.fixture(scope="module")
def pool(spark):
    return spark.createDataFrame(POOL, "cand_id bigint, text string, label int")


@pytest.fixture(scope="module")
def finished(spark, real, pool):
    return SelectionRun(spark, real, CONFIG).run(pool)


# The same run row by row in plain Python, written from the formulas.


def words(text):
    return re.findall(r"[a-z0-9]+", text.lower())[:128]


def bits(text, digits=13):
    return int(hashlib.md5(text.encode()).hexdigest()[:digits], 16)


def vector(text):
    v = np.zeros(CONFIG.embedding_dim)
    for w in words(text):
        v[bits(w, 7) % CONFIG.embedding_dim] += 1
    return v / (np.linalg.norm(v) + 1e-9)


def fitted(rows):
    counts = [Counter(w for t, l in rows if l == c for w in words(t)) for c in (0, 1)]
    vocabulary = set(counts[0]) | set(counts[1])
    priors = [log((sum(l == c for _, l in rows) + 1) / (len(rows) + 2)) for c in (0, 1)]

    def probs(text):
        known = [w for w in words(text) if w in vocabulary]
        z = [
            priors[c] + sum(log((counts[c][w] + 1) / (sum(counts[c].values()) + len(vocabulary)))
                            for w in known) / max(1, len(known))
            for c in (0, 1)
        ]
        grown = [exp(x - max(z)) for x in z]
        return [g / sum(grown) for g in grown]

    return probs


def f1(probs, split):
    pairs = [(l, max((0, 1), key=lambda c: (round(probs(t)[c], 12), -c))) for _, t, l, s in REAL if s == split]
    scores = []
    for c in {x for p in pairs for x in p}:
        tp = sum(l == p == c for l, p in pairs)
        scores.append(2 * tp / (sum(l == c for l, _ in pairs) + sum(p == c for _, p in pairs)))
    return sum(scores) / len(scores)


def sequential():
    train = [(t, l) for _, t, l, s in REAL if s == "train"]
    known = np.stack([vector(t) for t, _ in train])
    ordered = sorted(POOL, key=lambda r: (bits(f"pool:42:{r[0]}"), r[0]))
    probs = fitted(train)
    before, curated, clock = f1(probs, "val"), [], 0
    counts, means, rounds = [0, 0], [0.0, 0.0], [(0, 0, 0, 0, before, None)]
    for k in range(1, CONFIG.max_rounds + 1):
        batch = ordered[(k - 1) * CONFIG.batch_size : k * CONFIG.batch_size]
        if len(curated) >= CONFIG.target_size or not batch:
            break
        accepted = []
        for cand, text, label in batch:
            clock += 1
            p = probs(text)
            u = -sum(x * log(x + 1e-9) for x in p) / log(2)
            n = min(1.0, max(0.0, 1 - float((known @ vector(text)).max())))
            action = clock - 1
            if clock > 2:
                s = [means[a] + sqrt(log(clock) / (counts[a] + 1e-9)) for a in (0, 1)]
                action = int(s[1] * (1 + (u + n + p[label]) / 3) > s[0])
            if action:
                accepted.append((cand, text, label))
        curated = (curated + accepted)[: CONFIG.target_size]
        probs = fitted(train + [(t, l) for _, t, l in curated])
        now = f1(probs, "val")
        arm, reward, before = int(bool(accepted)), now - before, now
        counts[arm] += 1
        means[arm] += (reward - means[arm]) / counts[arm]
        rounds.append((k, len(batch), len(accepted), len(curated), now, reward))
    return rounds, [c for c, _, _ in curated], f1(probs, "test")


def log_of(run):
    names = ("iteration", "n_batch", "n_accepted", "curated_total", "val_f1", "reward")
    return [tuple(r[n] for n in names) for r in run.rounds.orderBy("iteration").collect()]


def test_loop_equals_the_sequential_run(finished):
    rounds, curated, test_f1 = sequential()
    assert [pytest.approx(r) for r in rounds] == log_of(finished)
    assert [r["cand_id"] for r in finished.curated().orderBy("t").collect()] == curated
    scores = {r["regime"]: r for r in finished.regimes().collect()}
    assert scores["bandit_guided"]["test_f1"] == pytest.approx(test_f1)
    assert scores["real_only"]["val_f1"] == pytest.approx(rounds[0][4])


def test_invariants(finished):
    rounds = log_of(finished)
    assert rounds[-1][3] <= CONFIG.target_size and finished.curated().count() == rounds[-1][3]
    rewards = [r[5] for r in rounds if r[5] is not None]
    assert len(rewards) == len(rounds) - 1
    assert sum(rewards) == pytest.approx(rounds[-1][4] - rounds[0][4])
    assert finished.decisions.groupBy("cand_id").count().filter("count > 1").count() == 0


def test_a_finished_run_is_not_played_again(spark, real, pool, finished):
    before = log_of(finished)
    again = SelectionRun(spark, real, CONFIG, finished.folder).run(pool)
    assert log_of(again) == before


def test_an_interrupted_run_goes_on(spark, real, pool, finished):
    run = SelectionRun(spark, real, CONFIG)
    staged = run.stage(pool)
    run.play(1, staged.filter("batch_no = 1"), run._round(0).asDict())
    resumed = SelectionRun(spark, real, CONFIG, run.folder).run(pool)
    assert log_of(resumed) == log_of(finished)


class Always(Policy):
    def __init__(self, answer):
        self.answer = answer

    def arm_scores(self, state, t, row_id):
        return F.lit(1.0 - self.answer), F.lit(float(self.answer))


def test_rejecting_everything_keeps_the_model(spark, real, pool):
    run = SelectionRun(spark, real, CONFIG, policy=Always(0)).run(pool)
    rounds = log_of(run)
    assert len(rounds) == 7 and all(r[2:4] == (0, 0) and r[5] in (None, 0.0) for r in rounds)
    assert {r["arm"] for r in run.rounds.filter("iteration > 0").collect()} == {0}
    assert run.curated().count() == 0


def test_the_cut_keeps_the_first_accepted_rows(spark, real, pool):
    config = SelectionConfig(num_classes=2, target_size=40, batch_size=30, max_rounds=6, embedding_dim=16)
    run = SelectionRun(spark, real, config, policy=Always(1)).run(pool)
    assert [r[3] for r in log_of(run)] == [0, 30, 40]
    assert [r["t"] for r in run.curated().orderBy("t").collect()] == list(range(1, 41))


@pytest.mark.parametrize("target, rows", [(0, None), (60, 0)])
def test_nothing_to_play(spark, real, pool, target, rows):
    config = SelectionConfig(num_classes=2, target_size=target, batch_size=30, embedding_dim=16)
    run = SelectionRun(spark, real, config).run(pool if rows is None else pool.limit(rows))
    assert [r[0] for r in log_of(run)] == [0]
    assert run.decisions.count() == 0 and run.curated().count() == 0
    assert {r["regime"] for r in run.regimes().collect()} == {"real_only", "naive_augmentation", "bandit_guided"}


def test_stream_equals_the_loop_and_ignores_replays(spark, real, pool, finished, tmp_path):
    ordered = in_batches(pool, "cand_id", CONFIG.batch_size, CONFIG.seed).cache()
    landing = str(tmp_path / "landing")
    for k in range(1, 7):
        part = ordered.filter(F.col("batch_no") == k).select("cand_id", "text", "label")
        part.coalesce(1).write.mode("append").parquet(landing)
    run = run_stream(SelectionRun(spark, real, CONFIG), arriving_pool(spark, landing))
    assert log_of(run) == log_of(finished)
    play_arrivals(run, ordered.filter("batch_no = 1").select("cand_id", "text", "label"), 0)
    assert log_of(run) == log_of(finished)
    assert run.curated().count() == finished.curated().count()


def test_stream_keeps_what_arrives_behind_the_target(spark, real, pool, tmp_path):
    ordered = in_batches(pool, "cand_id", CONFIG.batch_size, CONFIG.seed).cache()
    landing = str(tmp_path / "landing")
    for k in range(1, 4):
        part = ordered.filter(F.col("batch_no") == k).select("cand_id", "text", "label")
        part.coalesce(1).write.mode("append").parquet(landing)
    size = ordered.filter("batch_no <= 3").count()
    settings = dict(num_classes=2, batch_size=30, embedding_dim=16)
    small = SelectionConfig(target_size=5, max_rounds=6, **settings)
    run = run_stream(SelectionRun(spark, real, small, policy=Always(1)), arriving_pool(spark, landing))
    assert [r[3] for r in log_of(run)] == [0, 5]
    assert run.pool.count() == size and run.undecided() == size - CONFIG.batch_size
    assert sorted(r.t for r in run.pool.collect()) == list(range(1, size + 1))
    large = SelectionConfig(target_size=1000, max_rounds=2, **settings)
    later = run_stream(SelectionRun(spark, real, large, run.folder, policy=Always(1)), arriving_pool(spark, landing))
    assert len(log_of(later)) == 3 and later.undecided() == size - 2 * CONFIG.batch_size


def test_settings_are_checked():
    for bad in ({"num_classes": 0}, {"batch_size": 0}, {"target_size": -1}):
        with pytest.raises(ValueError):
            SelectionConfig(**bad)
