"""Time the headline queries and print one JSON line.

Every query runs once to warm up and once on the clock; its result goes to Spark's no-op sink,
so all rows and columns are computed and none are shipped to Python.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "batch_assign",
    "fixed_splits",
    "template_pool",
    "tokenise_truncate",
    "hashed_embedding",
    "novelty_score",
    "novelty_by_blocks",
    "nearest_real",
    "nearest_real_by_blocks",
    "novelty_by_pivots",
    "nearest_real_by_pivots",
    "nb_model",
    "nb_probabilities",
    "nb_probabilities_shuffled",
    "macro_f1",
    "score_candidates",
    "lr_model",
    "regime_baselines",
    "policy_state",
    "policy_state_running",
    "ucb_replay",
    "thompson_replay",
    "replay_open_batch",
    "linear_ucb_replay",
    "thompson_long_log",
    "replay_many_runs",
    "accept_capped",
    "closed_loop",
)


def main() -> None:
    from pyspark.sql import SparkSession

    from gleanspark.registered import QUERIES

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds = {}
    for name in HEADLINE:
        run(name)
        seconds[name] = round(run(name), 3)
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries, second run each",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
