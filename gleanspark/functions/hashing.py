"""Random choices keyed by row id, equal for every partitioning and every rerun."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

HEX_DIGITS = 13
SPAN = 1 << (4 * HEX_DIGITS)


def draw_bits(seed: int, tag: str, *ids: Column) -> Column:
    """52 pseudo-random bits for the row named by ``ids``."""
    key = F.concat_ws(":", F.lit(tag), F.lit(str(seed)), *[i.cast("string") for i in ids])
    return F.conv(F.substring(F.md5(key), 1, HEX_DIGITS), 16, 10).cast("bigint")


def uniform(seed: int, tag: str, *ids: Column) -> Column:
    """A draw from [0, 1)."""
    return draw_bits(seed, tag, *ids) / F.lit(float(SPAN))


def positive_uniform(seed: int, tag: str, *ids: Column) -> Column:
    """A draw from (0, 1), safe below a logarithm."""
    return (draw_bits(seed, tag, *ids) + 1) / F.lit(float(SPAN + 1))


def choose(options: Sequence[str], draw: Column) -> Column:
    """One of ``options``, by a draw from [0, 1)."""
    index = F.floor(draw * F.lit(len(options))).cast("int")
    return F.get(F.array(*[F.lit(o) for o in options]), index)
