"""Order-dependent operators that never sort or number a whole table in one task.

A table is cut into chunks that follow the wanted order. Counting the chunks gives each
one its offset (at most ``CHUNKS`` rows, so it is broadcast), and rows are numbered inside
their chunk only.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanspark.functions.hashing import HEX_DIGITS, draw_bits, uniform

CHUNK_BITS = 16
CHUNKS = 1 << CHUNK_BITS
MIN_CHUNK_ROWS = 10_000


def numbered(
    df: DataFrame,
    chunk: Column,
    order: Sequence[Column],
    out: str,
    limit: int | None = None,
) -> DataFrame:
    """Add the 1-based global row number in (``chunk``, ``order``) as ``out``.

    ``chunk`` must rise with ``order`` and take at most ``CHUNKS`` values. With ``limit``
    only the first rows are returned; chunks wholly behind it are dropped before the shuffle.
    """
    running = Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        df.groupBy(chunk.alias("_chunk"))
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select("_chunk", F.coalesce(F.sum("_rows").over(running), F.lit(0)).alias("_before"))
    )
    if limit is not None:
        offsets = offsets.filter(F.col("_before") < limit)
    inside = Window.partitionBy("_chunk").orderBy(*order)
    placed = (
        df.withColumn("_chunk", chunk)
        .join(F.broadcast(offsets), "_chunk")
        .withColumn(out, F.col("_before") + F.row_number().over(inside))
        .drop("_chunk", "_before")
    )
    return placed if limit is None else placed.filter(F.col(out) <= limit)


def shuffled(
    df: DataFrame, id_col: str, seed: int, tag: str, out: str, limit: int | None = None
) -> DataFrame:
    """Number the rows of ``df`` in seeded random order; keep the first ``limit``."""
    bits = draw_bits(seed, tag, F.col(id_col))
    chunk = F.shiftright(bits, 4 * HEX_DIGITS - CHUNK_BITS)
    return numbered(df, chunk, [bits, F.col(id_col)], out, limit)


def take_shuffled(df: DataFrame, id_col: str, n: int, seed: int, tag: str = "shuffle") -> DataFrame:
    """The first ``n`` rows in seeded random order."""
    return shuffled(df, id_col, seed, tag, "_place", n).drop("_place")


def fixed_splits(
    df: DataFrame, id_col: str, sizes: Mapping[str, int], seed: int, tag: str = "shuffle"
) -> DataFrame:
    """Contiguous bands of the shuffled rows; a short input shortens the later splits."""
    placed = shuffled(df, id_col, seed, tag, "_place", sum(sizes.values()))
    split, end = F.lit(None).cast("string"), 0
    for name, size in sizes.items():
        start, end = end, end + size
        inside = (F.col("_place") > start) & (F.col("_place") <= end)
        split = F.when(inside, F.lit(name)).otherwise(split)
    return placed.withColumn("split", split).drop("_place")


def band_splits(
    df: DataFrame, id_col: str, shares: Mapping[str, float], rest: str, seed: int, tag: str = "split"
) -> DataFrame:
    """Splits by share of the hashed id, without a shuffle; what is left becomes ``rest``."""
    draw = uniform(seed, tag, F.col(id_col))
    ends, end = [], 0.0
    for name, share in shares.items():
        end = round(end + share, 12)
        ends.append((name, end))
    split = F.lit(rest)
    for name, end in reversed(ends):
        split = F.when(draw < F.lit(end), F.lit(name)).otherwise(split)
    return df.withColumn("split", split)


def in_batches(
    df: DataFrame, id_col: str, batch_size: int, seed: int, tag: str = "pool"
) -> DataFrame:
    """Add the selection clock ``t`` (from 1) and ``batch_no`` (from 1)."""
    return shuffled(df, id_col, seed, tag, "t").withColumn("batch_no", batch_of("t", batch_size))


def batch_of(t: str, batch_size: int) -> Column:
    return (F.floor((F.col(t) - 1) / F.lit(batch_size)) + 1).cast("int")


def first_in_order(df: DataFrame, order_col: str, n: int, out: str = "place") -> DataFrame:
    """The first ``n`` rows by a unique clock ``order_col`` (from 1), numbered from 1.

    ``df`` is read three times, so it should be a written table.
    """
    top = df.agg(F.max(order_col)).first()[0] or 0
    width = max(MIN_CHUNK_ROWS, ceil(top / CHUNKS))
    return numbered(df, F.floor(F.col(order_col) / F.lit(width)), [F.col(order_col)], out, n)
