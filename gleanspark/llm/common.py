"""Helpers the operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Words are runs of anything but the six ASCII blanks, which is what bytes.split() cuts at.
BLANKS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def share_of(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a NULL id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % F.lit(parts)


def shelters(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """For functions of a table that add columns ``__…`` for a while: columns of the table that have
    such a name are put aside under another one, and come back as they were."""

    @wraps(stage)
    def run(docs: DataFrame, *args, **options) -> DataFrame:
        aside = {c: f"_kept_{n}" for n, c in enumerate(docs.columns) if c.startswith("__")}
        while set(aside.values()) & set(docs.columns):
            aside = {c: f"_{name}" for c, name in aside.items()}
        out = stage(docs.withColumnsRenamed(aside), *args, **options)
        return out.withColumnsRenamed({name: c for c, name in aside.items()})

    return run


def utf8(column: pa.Array) -> Iterator[bytes]:
    """The texts of an Arrow column as UTF-8, NULL as the empty text, one at a time."""
    for value in column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()):
        yield value.as_py() or b""


def arrow_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], ddl).schema)


def map_rows(
    df: DataFrame,
    work: Callable[[], Callable[[pa.RecordBatch], dict[str, Iterable]]],
    added: str,
    keep: list[str] | None = None,
) -> DataFrame:
    """Add columns computed batch by batch inside the tasks, without a shuffle.

    ``work()`` is called once per task and returns the function that turns a batch into the new
    columns; ``added`` is their schema, which replaces columns of the same name. ``keep`` names the
    columns to hand on, all by default.
    """
    new = df.sparkSession.createDataFrame([], added).schema
    names = set(new.names)
    kept = [f for f in df.schema if f.name not in names and (keep is None or f.name in keep)]
    schema = type(new)(kept + list(new))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        types = {f.name: to_arrow_type(f.dataType) for f in new}
        step = work()
        for batch in batches:
            out = step(batch)
            arrays = [batch.column(f.name) for f in kept]
            arrays += [pa.array(out[n], types[n]) for n in types]
            yield pa.RecordBatch.from_arrays(arrays, [f.name for f in kept] + list(types))

    return df.mapInArrow(run, schema)


# A key is hot with over one in so many rows, so there are fewer hot keys than that.
HOT_KEYS = 1000


def join_by_frequency(many: DataFrame, few: DataFrame, counts: DataFrame, key: str) -> DataFrame:
    """Inner join on ``key`` in which no key sends its rows of ``many`` to one task.

    ``counts(key, n)`` has the rows of ``many`` per key. Hot keys meet their rows of ``few`` by
    broadcast; a key has few rows there. The others meet by shuffle.
    """
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = counts.filter(F.col("n") > total / HOT_KEYS).select(key)
    by_broadcast = many.join(F.broadcast(few.join(F.broadcast(hot), key, "left_semi")), key)
    rest = many.join(F.broadcast(hot), key, "left_anti").join(few.join(F.broadcast(hot), key, "left_anti"), key)
    return by_broadcast.unionByName(rest)
