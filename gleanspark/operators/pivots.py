"""Exact nearest trusted vectors with most pairs left out: cells around pivots.

Trusted vectors are dealt to the nearest of k centres, which are fitted in Spark (a start drawn by
hash, then a few rounds of spherical k-means whose sums are aggregated over all rows). A cell keeps
its radius, the largest angle between its centre and a member. By the triangle inequality of angles,
no member is nearer to a candidate than the angle to the centre less the radius, which bounds the
cell's best similarity from above.

A candidate visits the cells from the highest bound down, one in the first round, four times as many
in each round after, and stops when the next bound lies below the best similarity it has met.
Cells of equal bound order by number, so nothing hangs on the partitions. Visits are counted per cell
before they are dealt: a popular cell is copied for several blocks of candidates and a large one is
cut into parts, so that a task holds one block of either side. Only figures per cell come to the
driver; their number is bounded by ``CENTRE_BYTES``.

The result is the one of :mod:`gleanspark.operators.novelty`, ties included.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanspark.functions.vectors import as_doubles
from gleanspark.operators.novelty import TIE, first_reaching, largest, stack, unit_rows
from gleanspark.storage import materialize

CENTRE_BYTES = 32 << 20
FITTING_ROUNDS = 2
# Cells visited in the first round, and the factor for each round after.
FIRST_VISITS, MORE_VISITS = 1, 4
# Angles near zero are known to about 2e-8, so bounds are loosened by more than that.
SLACK = 1e-7
# Candidates whose bounds are worked out at a time.
BOUND_ROWS = 1024


def directions(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of length one, and the length each had; a zero row stays zero."""
    length = np.linalg.norm(matrix, axis=1)
    return matrix / np.where(length > 0, length, 1)[:, None], length


def cells_of(vectors: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cell, angle to its centre) of each vector; a zero vector has a cell of its own, the last."""
    unit, length = directions(vectors)
    cell, angle = np.zeros(len(unit), dtype=np.int64), np.zeros(len(unit))
    for start in range(0, len(unit), BOUND_ROWS):
        part = slice(start, start + BOUND_ROWS)
        cosine = unit[part] @ centres.T
        cell[part] = cosine.argmax(axis=1)
        angle[part] = np.arccos(np.clip(cosine.max(axis=1), -1, 1))
    return np.where(length > 0, cell, len(centres)), np.where(length > 0, angle, 0)


class Bounds:
    """What the cells promise at most, from one row of figures per cell that has members."""

    def __init__(self, centres: np.ndarray, figures: list):
        figures = sorted(figures, key=lambda f: f["cell"])
        self.cells = np.array([f["cell"] for f in figures], dtype=np.int64)
        zero = np.zeros((1, centres.shape[1]))
        self.centres = np.concatenate([centres, zero])[self.cells]
        self.radius = np.array([f["radius"] for f in figures])
        self.shortest, self.longest = (np.array([f[n] for f in figures]) for n in ("shortest", "longest"))

    def of(self, vectors: np.ndarray) -> np.ndarray:
        """The largest similarity each candidate can meet in each cell."""
        unit, length = directions(vectors)
        angle = np.arccos(np.clip(unit @ self.centres.T, -1, 1)) - self.radius
        cosine = np.cos(np.clip(angle, 0, np.pi))
        return cosine * length[:, None] * np.where(cosine > 0, self.longest, self.shortest) + SLACK

    def next_cells(self, vectors: np.ndarray, top: np.ndarray, seen: int, most: int) -> Iterator[tuple[list[int], bool]]:
        """The next cells to visit of each candidate, and whether more may win after them."""
        for start in range(0, len(vectors), BOUND_ROWS):
            bound = self.of(vectors[start : start + BOUND_ROWS])
            order = np.argsort(-bound, axis=1, kind="stable")
            best = top[start : start + BOUND_ROWS] - TIE
            able = (bound >= best[:, None]).sum(axis=1)
            for row, n in zip(order, able.tolist()):
                yield self.cells[row[seen : min(n, seen + most)]].tolist(), n > seen + most


class PivotIndex:
    """Cells of the distinct trusted vectors ``rows(real_vector, real_id)``.

    ``pairs`` counts the pairs of vectors met by all calls of :meth:`near`, the second meeting for
    ids left aside.
    """

    def __init__(self, rows: DataFrame, count: int, dim: int, block_bytes: int, cells: int | None = None):
        self.rows_per_block = max(1, block_bytes // (8 * dim))
        self.pairs = 0
        k = max(1, min(cells or isqrt(count), CENTRE_BYTES // (8 * dim), count))
        self.centres = self._fitted(rows, k)
        self.members = materialize(self._dealt(rows), "pivot-cells")
        stats = self.members.groupBy("cell").agg(
            F.count(F.lit(1)).alias("n"), F.max("angle").alias("radius"),
            F.min("length").alias("shortest"), F.max("length").alias("longest"),
        ).collect()
        self.sizes = {s["cell"]: s["n"] for s in stats}
        self.bounds = Bounds(self.centres, stats)

    def _fitted(self, rows: DataFrame, k: int) -> np.ndarray:
        start = rows.orderBy(F.xxhash64("real_vector"), "real_id").limit(k).toArrow()
        centres = directions(stack(start["real_vector"]))[0]
        dim = centres.shape[1]

        def sums(centres: np.ndarray):
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                total, members = np.zeros_like(centres), np.zeros(len(centres), dtype=np.int64)
                for batch in batches:
                    vectors = stack(batch.column("real_vector"))
                    if not len(vectors):
                        continue
                    unit, _ = directions(vectors)
                    cell, _ = cells_of(unit, centres)
                    inside = cell < len(centres)
                    np.add.at(total, cell[inside], unit[inside])
                    members += np.bincount(cell[inside], minlength=len(centres))
                met = np.flatnonzero(members)
                lists = pa.array(list(total[met]), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([pa.array(met), lists], ["cell", "total"])

            return run

        for _ in range(FITTING_ROUNDS):
            parts = rows.select("real_vector").mapInArrow(sums(centres), "cell bigint, total array<double>")
            added = parts.groupBy("cell").agg(
                F.array(*[F.sum(F.get("total", F.lit(i))) for i in range(dim)]).alias("total")
            )
            new = centres.copy()
            for row in added.collect():
                new[row["cell"]] = row["total"]
            unit, length = directions(new)
            # A cell without members, or whose members cancel out, keeps its centre.
            centres = np.where(length[:, None] > 1e-6, unit, centres)
        return centres

    def _dealt(self, rows: DataFrame) -> DataFrame:
        centres = self.centres

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                vectors = stack(batch.column("real_vector"))
                if not len(vectors):
                    continue
                vectors = unit_rows(vectors)
                cell, angle = cells_of(vectors, centres)
                arrays = [pa.array(cell), pa.array(angle), pa.array(np.linalg.norm(vectors, axis=1))]
                yield pa.RecordBatch.from_arrays(
                    [*arrays, batch.column("real_id"), batch.column("real_vector")],
                    ["cell", "angle", "length", "real_id", "real_vector"],
                )

        schema = "cell bigint, angle double, length double, real_id bigint, real_vector array<double>"
        return rows.select("real_id", "real_vector").mapInArrow(run, schema)

    def _asked(self, state: DataFrame, seen: int, most: int) -> DataFrame:
        """``_row, vector, cells, more``: the cells each candidate visits in this round."""
        bounds = self.bounds

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                vectors = stack(batch.column("vector"))
                if not len(vectors):
                    continue
                if vectors.shape[1] != bounds.centres.shape[1]:
                    raise ValueError("every embedding needs the same length")
                top = batch.column("top").to_numpy(zero_copy_only=False)
                found = list(bounds.next_cells(unit_rows(vectors), top, seen, most))
                cells = pa.array([c for c, _ in found], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_row"), batch.column("vector"), cells, pa.array([m for _, m in found])],
                    ["_row", "vector", "cells", "more"],
                )

        return state.mapInArrow(run, "_row bigint, vector array<double>, cells array<bigint>, more boolean")

    def _blocks(self, visits: DataFrame) -> DataFrame:
        """``cell, parts, blocks``: how the members and the visitors of each cell are cut."""
        counts = visits.groupBy("cell").count().collect()
        self.pairs += sum(c["count"] * self.sizes[c["cell"]] for c in counts)
        cut = lambda n: ceil(n / self.rows_per_block)
        rows = [(c["cell"], cut(self.sizes[c["cell"]]), cut(c["count"])) for c in counts]
        return F.broadcast(visits.sparkSession.createDataFrame(rows, "cell bigint, parts int, blocks int"))

    def _meeting(self, visits: DataFrame, blocks: DataFrame, meet, schema: str, of_part: bool = False) -> DataFrame:
        """Every visitor meets every part of its cell, or the ``part`` it names."""
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        dealt = lambda col, n: F.pmod(F.xxhash64(col), F.col(n)).cast("int")
        keys = ["cell", "part", "block"]
        left = visits.join(blocks, "cell").withColumn("block", dealt("_row", "blocks"))
        left = (left if of_part else left.withColumn("part", every("parts"))).drop("parts", "blocks")
        right = self.members.select("cell", "real_id", "real_vector").join(blocks, "cell")
        right = right.withColumn("part", dealt("real_vector", "parts")).withColumn("block", every("blocks"))
        right = right.drop("parts", "blocks")
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, schema)

    def near(self, keyed: DataFrame, vector_col: str, with_id: bool) -> DataFrame:
        """``_row, _near`` of ``keyed(_row, …)``, as the other ways of the novelty search."""
        state = keyed.select(
            "_row", as_doubles(F.col(vector_col)).alias("vector"), F.lit(float("-inf")).alias("top")
        )
        met, seen, most = None, 0, FIRST_VISITS
        while True:
            asked = materialize(self._asked(state, seen, most), "pivot-asked")
            visits = asked.select("_row", "vector", F.explode("cells").alias("cell"))
            blocks = self._blocks(visits)
            schema = "_row bigint, cell bigint, part int, similarity double"
            found = materialize(self._meeting(visits, blocks, meet, schema), "pivot-met")
            met = found if met is None else met.unionByName(found)
            top = met.groupBy("_row").agg(F.max("similarity").alias("top"))
            left = asked.filter("more").select("_row", "vector")
            if left.isEmpty():
                break
            state = left.join(top, "_row")
            seen, most = seen + most, most * MORE_VISITS
        if not with_id:
            none = F.lit(None).cast("bigint").alias("real_id")
            return top.select("_row", F.struct(F.col("top").alias("similarity"), none).alias("_near"))
        top = materialize(top, "pivot-top")
        close = met.join(top, "_row").filter(F.col("similarity") >= F.col("top") - TIE).drop("similarity")
        vectors = keyed.select("_row", as_doubles(F.col(vector_col)).alias("vector"))
        again = materialize(close.join(vectors, "_row"), "pivot-close")
        counted = self.pairs
        blocks = self._blocks(again.select("cell", "_row").distinct())
        self.pairs = counted
        places = self._meeting(again, blocks, meet_again, "_row bigint, real_id bigint", of_part=True)
        first = places.groupBy("_row").agg(F.min("real_id").alias("real_id"))
        near = F.struct(F.col("top").alias("similarity"), "real_id").alias("_near")
        return top.join(first, "_row", "left").select("_row", near)


def sides(visitors: pa.Table, members: pa.Table) -> tuple[np.ndarray, np.ndarray, pa.ChunkedArray]:
    members = members.sort_by("real_id")
    return unit_rows(stack(visitors["vector"])), unit_rows(stack(members["real_vector"])), members["real_id"]


def meet(visitors: pa.Table, members: pa.Table) -> pa.Table:
    """The largest similarity each visitor finds in a part of a cell."""
    similarity = np.zeros(0)
    if visitors.num_rows and members.num_rows:
        queries, trusted, _ = sides(visitors, members)
        similarity = largest(queries, trusted)
    visitors = visitors.slice(0, len(similarity)).select(["_row", "cell", "part"])
    return visitors.append_column("similarity", pa.array(similarity, pa.float64()))


def meet_again(visitors: pa.Table, members: pa.Table) -> pa.Table:
    """The smallest id in the part within ``TIE`` of each visitor's largest similarity."""
    rows, found = visitors["_row"].slice(0, 0), pa.array([], pa.int64())
    if visitors.num_rows and members.num_rows:
        queries, trusted, ids = sides(visitors, members)
        place = first_reaching(queries, trusted, visitors["top"].to_numpy() - TIE)
        rows = visitors["_row"].filter(pa.array(place >= 0))
        found = ids.take(pa.array(place[place >= 0]))
    return pa.table({"_row": rows, "real_id": found})
