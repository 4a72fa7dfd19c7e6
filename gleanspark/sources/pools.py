"""Candidate pools on disk."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanspark.sources.arrays import read_array
from gleanspark.storage import is_complete

POOL_SCHEMA = "cand_id bigint, text string, label int"
FORMATS = ("parquet", "json")
# Texts a task holds as Python objects at once.
HELD_ROWS = 100


def read_pool_array(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Read pool files holding one JSON array each; a large file is read by many tasks."""
    return read_array(spark, path, POOL_SCHEMA if with_ids else "text string, label int")


def write_pool_array(pool: DataFrame, path: str) -> None:
    """Write a pool as one JSON array per part file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = "["
        for batch in batches:
            for start in range(0, batch.num_rows, HELD_ROWS):
                lines = []
                for row in batch.column(0).slice(start, HELD_ROWS).to_pylist():
                    lines.append(before + row)
                    before = ","
                yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], ["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["[]" if before == "[" else "]"])], ["value"])

    rows = pool.select(F.to_json(F.struct("cand_id", "text", "label")).alias("value"))
    rows.mapInArrow(run, "value string").write.mode("overwrite").text(path)


def read_pool(spark: SparkSession, path: str, pool_format: str = "parquet") -> DataFrame:
    """Read a pool written by :func:`write_pool` (``json`` means JSON lines)."""
    return spark.read.schema(POOL_SCHEMA).format(pool_format).load(path)


def write_pool(pool: DataFrame, path: str, pool_format: str = "parquet") -> None:
    if pool_format not in FORMATS:
        raise ValueError(f"unknown pool format {pool_format!r}; known are {FORMATS}")
    pool.select("cand_id", "text", "label").write.mode("overwrite").format(pool_format).save(path)


def pool_once(
    spark: SparkSession,
    path: str,
    size: int,
    seed: int,
    build: Callable[[], DataFrame],
    pool_format: str = "parquet",
) -> DataFrame:
    """Load the pool at ``path``, or build and write it.

    Size and seed are kept beside the pool; asking for others is an error. A pool without
    that note came from elsewhere and is taken as it is. The note is written before the pool, so a
    pool of ours has one however the call ended.
    """
    note = f"{path.rstrip('/')}.made"
    if is_complete(spark, path):
        if is_complete(spark, note):
            made = spark.read.schema("size bigint, seed bigint").json(note).first()
            if (made["size"], made["seed"]) != (size, seed):
                raise ValueError(
                    f"pool at {path} was made with size {made['size']}, seed {made['seed']}"
                )
        return read_pool(spark, path, pool_format)
    spark.createDataFrame([(size, seed)], "size bigint, seed bigint").write.mode(
        "overwrite"
    ).json(note)
    write_pool(build(), path, pool_format)
    return read_pool(spark, path, pool_format)
