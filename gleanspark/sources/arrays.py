"""Large JSON arrays, read by as many tasks as the files have ranges.

Spark splits a text file at any separator it is told, and every element of an array of objects
ends with a closing brace. So the file is read as fragments that end with one, in their order within
each range, and whether a brace closes an element is found in two passes:

1. Every range counts its quotes, and the braces and brackets between them, once for either
   reading: that the range begins outside a string or inside one. The driver, which gets five numbers per
   range, carries the state across the ranges of each file.
2. With its first state known, a range cuts out its elements. What it holds of elements that
   cross its borders is put together by a running count of such elements, also in ranges.

Elements are parsed by Spark; anything that is not an array of objects is refused.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanspark.operators.prefix import in_segments, running
from gleanspark.storage import materialize

SIGN = re.compile(rb'\\.|["{}\[\]]', re.DOTALL)
STEP = {b"{": 1, b"[": 1, b"}": -1, b"]": -1}
BEFORE_FIRST = re.compile(rb"(?:\xef\xbb\xbf)?\s*\[\s*")
BEFORE_NEXT = re.compile(rb"\s*,\s*")
AFTER_LAST = re.compile(rb"\s*\]\s*")
EMPTY = re.compile(rb"(?:\xef\xbb\xbf)?\s*\[\s*\]\s*")


def steps(fragment: bytes) -> tuple[int, int, int]:
    """(quotes, depth gained outside strings if it begins outside, the same if it begins inside)."""
    quotes, gained = 0, [0, 0]
    for sign in SIGN.finditer(fragment):
        found = sign.group()
        if found == b'"':
            quotes += 1
        elif found in STEP:
            gained[quotes % 2] += STEP[found]
    return quotes, gained[0], gained[1]


@dataclass(frozen=True)
class State:
    """Inside a string or not, and the number of open brackets and braces."""

    quoted: bool = False
    depth: int = 0

    def after(self, quotes: int, outside: int, inside: int) -> "State":
        return State(self.quoted != bool(quotes % 2), self.depth + (inside if self.quoted else outside))

    @property
    def in_element(self) -> bool:
        return self.quoted or self.depth > 1


def fragments(spark: SparkSession, path: str) -> DataFrame:
    """``file, start, value``: the pieces between closing braces, in order within each range."""
    lines = spark.read.option("lineSep", "}").text(path)
    return lines.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.col("value").cast("binary").alias("value"),
    )


def by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], bytes | None]]:
    """((file, start), fragment) in order; (range, None) once at the end of each range."""
    now = None
    for batch in batches:
        for file, start, value in zip(*(batch.column(n) for n in ("file", "start", "value"))):
            key = (file.as_py(), start.as_py())
            if now is not None and now != key:
                yield now, None
            now = key
            yield key, value.as_py()
    if now is not None:
        yield now, None


def joined(a: tuple[int, int, int], b: tuple[int, int, int]) -> tuple[int, int, int]:
    """The steps of two pieces in a row; an odd number of quotes swaps the readings of the second."""
    swapped = a[0] % 2
    return a[0] + b[0], a[1] + b[1 + swapped], a[2] + b[2 - swapped]


BRACE = (0, -1, 0)


def first_states(pieces: DataFrame) -> tuple[dict[tuple[str, int], State], set[tuple[str, int]]]:
    """The state before each range, and the last range of each file."""
    names = ["file", "start", "quotes", "outside", "inside", "bare_quotes", "bare_outside", "bare_inside"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = bare = (0, 0, 0)
        for key, fragment in by_range(batches):
            if fragment is not None:
                bare = joined(total, steps(fragment))
                total = joined(bare, BRACE)
                continue
            row = [*key, *total, *bare]
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in row], names)
            total = bare = (0, 0, 0)

    schema = "file string, " + ", ".join(f"{n} bigint" for n in names[1:])
    ranges = sorted(tuple(r) for r in pieces.mapInArrow(count, schema).collect())
    found, last = {}, set()
    state = State()
    for place, (file, start, *counts) in enumerate(ranges):
        found[file, start] = state
        if place + 1 < len(ranges) and ranges[place + 1][0] == file:
            state = state.after(*counts[:3])
            continue
        # The last piece of a file has no brace behind it.
        if state.after(*counts[3:]) != State():
            raise ValueError(f"{file} ends inside its array")
        last.add((file, start))
        state = State()
    return found, last


def element_of(before: State, data: bytes, file: str) -> bytes:
    """The element at the end of ``data``, which begins behind the element before."""
    gap = (BEFORE_FIRST if before.depth == 0 else BEFORE_NEXT).match(data)
    if not gap or data[gap.end() : gap.end() + 1] != b"{":
        raise ValueError(f"{file} is not an array of objects")
    return data[gap.end() :]


def cut(pieces: DataFrame, states: dict, last: set) -> DataFrame:
    """``element``, or of an element that crosses ranges its ``piece`` with its place in the file.

    ``begins`` marks the piece an element begins with; it has the gap before the element as well.
    """
    schema = "element string, file string, start bigint, place int, begins int, depth int, piece binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = [f.split() for f in schema.split(", ")]
        kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}

        def table(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*rows) if rows else [[]] * len(fields)
            arrays = [pa.array(c, kinds[kind]) for c, (_, kind) in zip(columns, fields)]
            return pa.RecordBatch.from_arrays(arrays, [n for n, _ in fields])

        def check_rest(state: State, rest: bytes, file: str) -> None:
            if not (AFTER_LAST if state.depth else EMPTY).fullmatch(rest):
                raise ValueError(f"{file} is not an array of objects")

        state, begun, held, waiting, crossing, out = State(), State(), [], None, False, []

        def take(key: tuple[str, int], fragment: bytes, braced: bool) -> None:
            nonlocal state, begun, held, crossing
            file, start = key
            if not braced:
                check_rest(state, b"".join(held) + fragment, file)
                held = []
                return
            held.append(fragment + b"}")
            state = state.after(*joined(steps(fragment), BRACE))
            if state.in_element:
                return
            if state.depth != 1:
                raise ValueError(f"{file} is not an array of objects")
            data = b"".join(held)
            if crossing:
                out.append((None, file, start, 0, 0, begun.depth, data))
            else:
                out.append((element_of(begun, data, file).decode(), None, None, None, None, None, None))
            held, begun, crossing = [], state, False

        for key, fragment in by_range(batches):
            if fragment is not None:
                if waiting is None:
                    state = begun = states[key]
                    held, crossing = [], state.in_element
                else:
                    take(key, waiting, True)
                waiting = fragment
            else:
                take(key, waiting, key not in last)
                if held:
                    out.append((None, *key, 1, int(not crossing), begun.depth, b"".join(held)))
                waiting = None
            if len(out) >= 1000:
                yield table(out)
                out.clear()
        yield table(out)

    return pieces.mapInArrow(run, schema)


def read_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The elements of the JSON arrays of objects at ``path``, one array per file.

    A file that ends inside its array, or holds anything else than an array of objects of this
    schema, is an error. Fields that are missing are NULL, others are passed over. The files are read
    three times, and only elements that cross ranges are shuffled.
    """
    pieces = fragments(spark, path)
    states, last = first_states(pieces)
    found = materialize(cut(pieces, states, last), "array")
    order = ["start", "place"]
    parts = found.filter("element IS NULL").drop("element")
    numbered = running(in_segments(parts, ["file"], order), ["file"], order, sums={"before": F.col("begins")})
    ordered = F.array_sort(F.collect_list(F.struct("start", "place", "depth", "piece")))
    crossing = numbered.groupBy("file", (F.col("before") + F.col("begins")).alias("n")).agg(ordered.alias("all"))
    data = F.aggregate("all", F.lit(b""), lambda whole, p: F.concat(whole, p["piece"]))

    @F.arrow_udf("string")
    def finished(file: pa.Array, depth: pa.Array, data: pa.Array) -> pa.Array:
        rows = zip(file.to_pylist(), depth.to_pylist(), data.to_pylist())
        return pa.array([element_of(State(depth=d), b, f).decode() for f, d, b in rows], pa.string())

    whole = crossing.select("file", F.get("all", F.lit(0))["depth"].alias("depth"), data.alias("data"))
    elements = found.filter("element IS NOT NULL").select("element").unionByName(
        whole.select(finished("file", "depth", "data").alias("element"))
    )
    parsed = F.from_json("element", schema, {"mode": "FAILFAST"})
    return elements.select(parsed.alias("row")).select("row.*")
