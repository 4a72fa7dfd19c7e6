"""Policy state folded from a stream of reward rows."""

import random
from collections import defaultdict

import pytest

from gleanspark.streaming import state as module
from gleanspark.streaming.state import fold_arrivals, folded_state

SCHEMA = "run string, iteration bigint, arm int, reward double"


def stream(spark, path):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


def expected(rows):
    """The state of each run, a round counted as it first came."""
    seen, sums = set(), defaultdict(lambda: [[0, 0.0, 0], [0, 0.0, 0]])
    for run, iteration, arm, reward in rows:
        if (run, iteration) not in seen:
            seen.add((run, iteration))
            n = sums[run][arm]
            n[0], n[1], n[2] = n[0] + 1, n[1] + reward, n[2] + (reward > 0)
    return {
        run: [(n, pytest.approx(s / n if n else 0.0), won + 1, n - won + 1) for n, s, won in arms]
        for run, arms in sums.items()
    }


def found(spark, folder):
    return {
        r["run"]: [(r[f"pulls_{a}"], r[f"mean_{a}"], r[f"alpha_{a}"], r[f"beta_{a}"]) for a in (0, 1)]
        for r in folded_state(spark, folder, ["run"]).collect()
    }


def test_late_and_repeated_rounds_and_a_restart(spark, tmp_path):
    """One run holds most of the rounds and reaches over three blocks; one run has no name."""
    rng = random.Random(31)
    rounds = [("big", i) for i in range(3 * module.SPAN - 5)] + [("small", i) for i in range(1, 9)] + [(None, 4), (None, 9000)]
    rng.shuffle(rounds)
    rows = [(run, i, rng.randrange(2), rng.randrange(-100, 101) / 64) for run, i in rounds]
    cut = [rows[:5000], rows[5000:5010] + rows[:40] + rows[5010:9000] + [("small", 77, 1, 0.0)] * 3, rows[9000:], rows[::50]]
    landing, folder = str(tmp_path / "landing"), str(tmp_path / "folded")
    arrived = []
    for place, part in enumerate(cut):
        spark.createDataFrame(part, SCHEMA).repartition(2).write.mode("append").parquet(landing)
        arrived += part
        if place != 1:
            fold_arrivals(stream(spark, landing), ["run"], folder)
            assert found(spark, folder) == expected(arrived)
    assert spark.read.parquet(f"{folder}/blocks").filter("run = 'big'").select("block").distinct().count() == 3


def test_rows_without_a_round_are_refused(spark, tmp_path):
    for place, row in enumerate([("a", None, 1, 0.5), ("a", 3, None, 0.5), ("a", 3, 2, 0.5), ("a", -1, 1, 0.5)]):
        landing = str(tmp_path / f"landing{place}")
        spark.createDataFrame([row], SCHEMA).write.parquet(landing)
        with pytest.raises(Exception, match="needs an iteration"):
            fold_arrivals(stream(spark, landing), ["run"], str(tmp_path / f"folded{place}"))


def test_no_python_runs_per_run(spark, tmp_path):
    """Many runs of few rounds cost what their rows cost: the state is kept without a Python call per run."""
    log = stream(spark, str(tmp_path))
    plan = module.first_seen(log, ["run"])._jdf.queryExecution().logical().toString()
    assert "Deduplicate" in plan and "Pandas" not in plan
