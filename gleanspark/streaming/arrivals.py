"""The selection loop fed by a stream: each micro-batch of arriving candidates is a round."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanspark.operators.ordering import shuffled
from gleanspark.plans.loop import VECTOR, SelectionRun
from gleanspark.plans.scoring import with_novelty, with_tokens
from gleanspark.sources.pools import POOL_SCHEMA
from gleanspark.storage import is_complete, write_table


def arriving_pool(
    spark: SparkSession, path: str, files_per_round: int = 1, own_vectors: bool = False
) -> DataFrame:
    """Candidates from the Parquet files landing in ``path``, with vectors of their own or without."""
    reader = spark.readStream.schema(POOL_SCHEMA + (f", {VECTOR}" if own_vectors else "")).option("maxFilesPerTrigger", files_per_round)
    return reader.parquet(path)


def play_waiting(run: SelectionRun, upto: int) -> None:
    """Play the staged micro-batches up to round ``upto`` that no round has looked at, in order."""
    for iteration in range(run._last_round() + 1, min(upto, run.config.max_rounds) + 1):
        last = run._round(run._last_round()).asDict()
        if run.finished(last):
            return
        run.play(iteration, run.pool.filter(F.col("batch_no") == iteration), last)


def play_arrivals(run: SelectionRun, batch: DataFrame, batch_id: int) -> None:
    """Stage micro-batch ``batch_id`` and play it as round ``batch_id + 1``.

    It is staged also when the target is reached or the rounds have run out, so a run with a larger
    target finds it. All state is read from the run's log before this round, and every table of the
    round is overwritten, so a batch delivered again changes nothing.
    """
    iteration = batch_id + 1
    if run._played(iteration):
        return
    offset = run.pool.filter(F.col("batch_no") < iteration).count() if _staged(run, 1) else 0
    placed = shuffled(run.candidates(batch), "cand_id", run.config.seed, "pool", "_place")
    timed = placed.withColumn("t", F.col("_place") + offset).drop("_place")
    write_table(
        with_novelty(with_tokens(timed, run.config), run.trusted, run.config),
        f"{run.folder}/pool/batch_no={iteration}",
    )
    play_waiting(run, iteration)


def _staged(run: SelectionRun, iteration: int) -> bool:
    return is_complete(run.spark, f"{run.folder}/pool/batch_no={iteration}")


def run_stream(run: SelectionRun, arrivals: DataFrame, checkpoint: str | None = None) -> SelectionRun:
    """Consume everything that has arrived, then stop."""
    query = (
        arrivals.writeStream.foreachBatch(lambda df, n: play_arrivals(run, df, n))
        .option("checkpointLocation", checkpoint or f"{run.folder}/stream")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    # Batches staged by an earlier run with a smaller target.
    arrived = 0
    while _staged(run, arrived + 1):
        arrived += 1
    play_waiting(run, arrived)
    return run
