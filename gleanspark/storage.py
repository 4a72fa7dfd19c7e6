"""Tables written to the folder all executors share.

Intermediate results that several jobs read are written there as Parquet: that cuts
the lineage, survives lost executors, and gives Catalyst a real size to plan with.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one in local mode only."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="gleanspark-"))
    return sc.getCheckpointDir().rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and return the written table."""
    return write_table(df, fresh_path(df.sparkSession, name))


def write_table(df: DataFrame, path: str, partition_by: str | None = None) -> DataFrame:
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(scan: DataFrame, key: str) -> DataFrame:
    """Deal a plain file scan out to all cores if it has fewer partitions than there are cores.

    Work that is heavy per row would otherwise wait for the few large row groups of a small
    table. A large table has more partitions than cores and is returned as it is.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores, key)


def is_complete(spark: SparkSession, path: str) -> bool:
    """True when a committed table lies at ``path``."""
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)


def written_once(
    spark: SparkSession,
    path: str,
    schema: str,
    build: Callable[[], DataFrame],
    partition_by: str | None = None,
) -> DataFrame:
    """The table at ``path``, built only if an earlier attempt did not finish it."""
    if not is_complete(spark, path):
        write_table(build(), path, partition_by)
    return spark.read.schema(schema).parquet(path)
