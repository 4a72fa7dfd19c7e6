"""Policy state of many runs, kept up to date while reward rows arrive.

The state store knows every round of every run that was seen, a few bytes for each, spread by run
and round. So a row that arrives late is counted when it comes, a row that arrives again is not, and a run that
holds most of the rows is no single task's work. What a micro-batch adds is written to a folder of its
own as sums by run and block of ``SPAN`` rounds; the state of a run is the sum over all of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanspark.operators.rewards import ARMS, all_tallies, arm_states
from gleanspark.storage import write_table

SPAN = 4096
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

SUMS = tuple(f"{name}_{arm}" for arm in ARMS for name in ("_n", "_sum", "_won"))


def first_seen(log: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of the stream ``log(*keys, iteration, arm, reward)`` whose round was not seen before."""
    wrong = F.raise_error(F.lit("a reward needs an iteration from 0 on and an arm")).cast("bigint")
    known = (F.col("iteration") >= 0) & F.col("arm").isin(*ARMS)
    number = F.when(known, F.col("iteration").cast("bigint")).otherwise(wrong)
    rows = log.select(
        *keys, number.alias("iteration"), "arm",
        # A reward that is not a number counts as a pull without a reward.
        F.nanvl(F.col("reward").cast("double"), F.lit(None)).alias("reward"),
    )
    return rows.dropDuplicates([*keys, "iteration"])


def block_sums(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sums of ``rows(*keys, iteration, arm, reward)`` by run and block of rounds."""
    block = F.floor(F.col("iteration") / SPAN).alias("block")
    sums = [F.coalesce(F.sum(e), F.lit(0)).alias(n) for n, e in all_tallies().items()]
    return rows.groupBy(*keys, block).agg(*sums)


def fold_arrivals(log: DataFrame, keys: Sequence[str], folder: str) -> None:
    """Fold everything that has arrived in the stream ``log`` into the state at ``folder``, then stop.

    Called again on the same folder it goes on with what has arrived since. A micro-batch that is
    delivered again overwrites what it wrote.
    """
    spark = log.sparkSession
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKS)
    try:
        query = (
            first_seen(log, keys).writeStream.outputMode("append")
            .foreachBatch(lambda df, n: write_table(block_sums(df, keys), f"{folder}/blocks/arrival={n}"))
            .option("checkpointLocation", f"{folder}/stream")
            .trigger(availableNow=True)
            .start()
        )
    finally:
        spark.conf.set(STORE, before)
    query.awaitTermination()


def folded_state(spark: SparkSession, folder: str, keys: Sequence[str]) -> DataFrame:
    """``*keys`` and the state of each run after all that was folded into ``folder``."""
    blocks = spark.read.parquet(f"{folder}/blocks")
    sums = blocks.groupBy(*keys).agg(*[F.sum(s).alias(s) for s in SUMS])
    return sums.select(*keys, *arm_states())
