"""Running values along one run's rows when a single run may hold most of the table.

The table is range-partitioned by (run, order) and written with its partition number as
``segment``. Each segment is worked on alone; what a run brings into a segment from earlier
ones is a carry. Only the first run of a segment can have one, so the carries never number
more than the segments and are broadcast.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanspark.storage import materialize


def in_segments(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], segments: int | None = None
) -> DataFrame:
    """Write ``df`` cut into ranges of (keys, order); ``segment`` names the range.

    Unless told how many, Spark takes its shuffle partitions and joins small ones.
    """
    count = () if segments is None else (segments,)
    ranged = df.repartitionByRange(*count, *keys, *order)
    return materialize(ranged.withColumn("segment", F.spark_partition_id()), "segments")


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    sums: Mapping[str, Column] | None = None,
    previous: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Add, per row, sums over the run's earlier rows and values of the row before.

    ``df`` comes from :func:`in_segments`. A sum is 0 and a previous value NULL on the first
    row of a run. ``order`` must be total within a run.
    """
    sums, previous = dict(sums or {}), dict(previous or {})
    place = Window.partitionBy("segment", *keys).orderBy(*order)
    earlier = place.rowsBetween(Window.unboundedPreceding, -1)
    by_segment = Window.partitionBy(*keys).orderBy("segment")
    earlier_segments = by_segment.rowsBetween(Window.unboundedPreceding, -1)

    totals = [F.sum(e).alias(n) for n, e in sums.items()]
    lasts = [F.max_by(e, F.struct(*order)).alias(n) for n, e in previous.items()]
    carries = (
        df.groupBy("segment", *keys)
        .agg(*totals, *lasts)
        .select(
            *[F.col(c).alias(f"_of_{c}") for c in ("segment", *keys)],
            F.row_number().over(by_segment).alias("_nth"),
            *[F.sum(n).over(earlier_segments).alias(f"_carry_{n}") for n in sums],
            *[F.lag(n).over(by_segment).alias(f"_carry_{n}") for n in previous],
        )
        .filter("_nth > 1")
        .drop("_nth")
    )
    local = df.select(
        "*",
        F.row_number().over(place).alias("_place"),
        *[F.sum(e).over(earlier).alias(f"_local_{n}") for n, e in sums.items()],
        *[F.lag(e).over(place).alias(f"_local_{n}") for n, e in previous.items()],
    )
    # Rows without a run key are a run of their own, so keys are matched with NULL equal to NULL.
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in ("segment", *keys)]
    joined = local.join(F.broadcast(carries), same, "left")
    zero = F.lit(0)
    return joined.select(
        *df.columns,
        *[
            (F.coalesce(f"_local_{n}", zero) + F.coalesce(f"_carry_{n}", zero)).alias(n)
            for n in sums
        ],
        *[
            F.when(F.col("_place") == 1, F.col(f"_carry_{n}"))
            .otherwise(F.col(f"_local_{n}"))
            .alias(n)
            for n in previous
        ],
    )
