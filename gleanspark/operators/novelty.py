"""Distance of each candidate to its nearest trusted row.

Equal trusted vectors count once, under their smallest id. A trusted side small enough is sent
to the executors as a matrix, and each Arrow batch of candidates is multiplied with it in place:
no shuffle. For a larger side the candidates are written once under a row key of their own and visit
cells of trusted vectors, of which most are left out (:mod:`gleanspark.operators.pivots`). With
``index="blocks"`` every block of candidates meets every trusted block instead, for vectors
without any structure. A task holds two blocks of ``block_bytes`` and a tile of similarities.

All ways give a row per candidate row, repeated and NULL ids included, and use one rule for
ties: of the trusted rows within ``TIE`` of the largest similarity, the smallest id.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanspark.config import EPSILON
from gleanspark.functions.vectors import as_doubles, clip_unit
from gleanspark.storage import materialize

BROADCAST_BYTES = 200 << 20
BLOCK_BYTES = 64 << 20
# Rows of either side multiplied at a time: a tile of similarities takes 32 MB at most.
TILE_ROWS = 2048
# Neighbours this close to the nearest count as tied with it; the smallest id wins.
TIE = 1e-9


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    return matrix / (np.linalg.norm(matrix, axis=1, keepdims=True) + EPSILON)


def tiles(rows: int) -> Iterator[slice]:
    return (slice(start, start + TILE_ROWS) for start in range(0, rows, TILE_ROWS))


def largest(queries: np.ndarray, trusted: np.ndarray) -> np.ndarray:
    """Largest similarity of each query."""
    if queries.shape[1] != trusted.shape[1]:
        raise ValueError("every embedding needs the same length")
    best = np.full(len(queries), -np.inf)
    for q in tiles(len(queries)):
        for r in tiles(len(trusted)):
            best[q] = np.maximum(best[q], (queries[q] @ trusted[r].T).max(axis=1))
    return best


def first_reaching(queries: np.ndarray, trusted: np.ndarray, bar: np.ndarray) -> np.ndarray:
    """The first trusted row whose similarity reaches each query's bar; -1 where none does."""
    place = np.full(len(queries), -1, dtype="int64")
    for q in tiles(len(queries)):
        for r in tiles(len(trusted)):
            reached = queries[q] @ trusted[r].T >= bar[q, None]
            new = (place[q] < 0) & reached.any(axis=1)
            place[q] = np.where(new, reached.argmax(axis=1) + r.start, place[q])
            if (place[q] >= 0).all():
                break
    return place


def stack(vectors: pa.Array) -> np.ndarray:
    """An Arrow list column as a matrix."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    if not len(vectors):
        return np.zeros((0, 0))
    sizes = np.diff(vectors.offsets.to_numpy())
    if vectors.null_count or (sizes != sizes[0]).any():
        raise ValueError("every embedding needs the same length")
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)


class TrustedSet:
    """Trusted vectors, measured once and reused for every batch of candidates."""

    def __init__(
        self,
        trusted: DataFrame,
        id_col: str,
        vector_col: str,
        broadcast_bytes: int = BROADCAST_BYTES,
        block_bytes: int = BLOCK_BYTES,
        index: str = "pivots",
        cells: int | None = None,
    ):
        if index not in ("pivots", "blocks"):
            raise ValueError(f"unknown index {index!r}; known are 'blocks' and 'pivots'")
        rows = trusted.select(
            F.col(id_col).cast("bigint").alias("real_id"),
            as_doubles(F.col(vector_col)).alias("real_vector"),
        )
        once = rows.groupBy("real_vector").agg(F.min("real_id").alias("real_id"))
        self.rows = materialize(once, "trusted")
        self.count, self.block_bytes = self.rows.count(), block_bytes
        if not self.count:
            raise ValueError("novelty needs at least one trusted row")
        self.dim = self.rows.select(F.size("real_vector")).first()[0]
        self.shared = None
        if self.count * self.dim * 8 <= broadcast_bytes:
            table = self.rows.toArrow().combine_chunks().sort_by("real_id")
            matrix = unit_rows(stack(table["real_vector"]))
            ids = table["real_id"].combine_chunks()
            self.shared = trusted.sparkSession.sparkContext.broadcast((ids, matrix))
        self.pivots = None
        if self.shared is None and index == "pivots":
            # That module builds on the rules for ties of this one.
            from gleanspark.operators.pivots import PivotIndex

            self.pivots = PivotIndex(self.rows, self.count, self.dim, block_bytes, cells)

    def neighbour(self, vector: Column, with_id: bool) -> Column:
        """struct<similarity, real_id> of the nearest trusted row; needs the broadcast matrix.

        Without ``with_id`` the id is left NULL, which saves a pass over the similarities.
        """
        shared = self.shared

        @F.arrow_udf("struct<similarity: double, real_id: bigint>")
        def look_up(vectors: pa.Array) -> pa.Array:
            ids, trusted = shared.value
            queries = stack(vectors)
            if not len(queries):
                queries = np.zeros((0, trusted.shape[1]))
            queries = unit_rows(queries)
            similarity = largest(queries, trusted)
            found = pa.nulls(len(queries), pa.int64())
            if with_id:
                found = ids.take(pa.array(first_reaching(queries, trusted, similarity - TIE)))
            return pa.StructArray.from_arrays(
                [pa.array(similarity), found], ["similarity", "real_id"]
            )

        return look_up(as_doubles(vector))

    def score(
        self, candidates: DataFrame, vector_col: str, with_id: bool = False
    ) -> DataFrame:
        """Add ``novelty``, and if asked for ``nearest_id``, to the candidates."""
        if self.shared is not None:
            found = candidates.withColumn("_near", self.neighbour(F.col(vector_col), with_id))
        else:
            own = candidates.withColumn("_row", F.monotonically_increasing_id())
            keyed = materialize(own, "candidates")
            near = self.pivots.near if self.pivots else self._by_blocks
            found = keyed.join(near(keyed, vector_col, with_id), "_row")
        added = [clip_unit(F.lit(1.0) - F.col("_near.similarity")).alias("novelty")]
        if with_id:
            added.append(F.col("_near.real_id").alias("nearest_id"))
        return found.select(*candidates.columns, *added)

    def _by_blocks(self, keyed: DataFrame, vector_col: str, with_id: bool) -> DataFrame:
        """``_row, _near`` of the written candidates.

        The first meeting finds the largest similarity. For the id, a candidate then meets again
        only the blocks that hold a row within ``TIE`` of it, nearly always one.
        """
        per_block = max(1, self.block_bytes // (8 * self.dim))
        blocks = ceil(keyed.count() / per_block) or 1
        real_blocks = ceil(self.count / per_block)
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        block = lambda col, n: F.pmod(F.xxhash64(col), F.lit(n)).cast("int")
        keys = ["block", "real_block"]

        left = keyed.select(
            "_row",
            as_doubles(F.col(vector_col)).alias("vector"),
            block("_row", blocks).alias("block"),
        )
        right = self.rows.select(
            "*",
            block("real_vector", real_blocks).alias("real_block"),
            every(blocks).alias("block"),
        ).groupBy(*keys)

        def sides(cands: pa.Table, reals: pa.Table) -> tuple:
            reals = reals.sort_by("real_id")
            queries, trusted = stack(cands["vector"]), stack(reals["real_vector"])
            return unit_rows(queries), unit_rows(trusted), reals["real_id"]

        def meet(cands: pa.Table, reals: pa.Table) -> pa.Table:
            similarity = np.zeros(0)
            if reals.num_rows and cands.num_rows:
                queries, trusted, _ = sides(cands, reals)
                similarity = largest(queries, trusted)
            cands = cands.slice(0, len(similarity)).select(["_row", "real_block"])
            return cands.append_column("similarity", pa.array(similarity, pa.float64()))

        def meet_again(cands: pa.Table, reals: pa.Table) -> pa.Table:
            rows, found = cands["_row"].slice(0, 0), pa.array([], pa.int64())
            if reals.num_rows and cands.num_rows:
                queries, trusted, ids = sides(cands, reals)
                place = first_reaching(queries, trusted, cands["top"].to_numpy() - TIE)
                rows = cands["_row"].filter(pa.array(place >= 0))
                found = ids.take(pa.array(place[place >= 0]))
            return pa.table({"_row": rows, "real_id": found})

        by_block = left.withColumn("real_block", every(real_blocks)).groupBy(*keys).cogroup(right)
        met = by_block.applyInArrow(meet, "_row bigint, real_block int, similarity double")
        if not with_id:
            top = met.groupBy("_row").agg(F.max("similarity").alias("similarity"))
            none = F.lit(None).cast("bigint").alias("real_id")
            return top.select("_row", F.struct("similarity", none).alias("_near"))
        met = materialize(met, "similarities")
        top = met.groupBy("_row").agg(F.max("similarity").alias("top"))
        close = met.join(top, "_row").filter(F.col("similarity") >= F.col("top") - TIE)
        asked = left.join(close.select("_row", "real_block", "top"), "_row")
        places = asked.groupBy(*keys).cogroup(right).applyInArrow(meet_again, "_row bigint, real_id bigint")
        first = places.groupBy("_row").agg(F.min("real_id").alias("real_id"))
        near = F.struct(F.col("top").alias("similarity"), "real_id").alias("_near")
        return top.join(first, "_row", "left").select("_row", near)


def novelty(
    candidates: DataFrame,
    trusted: DataFrame,
    id_col: str,
    vector_col: str,
    trusted_id: str | None = None,
    with_id: bool = False,
    **options,
) -> DataFrame:
    """1 - largest cosine to a trusted row, clipped to [0, 1]; if asked for, with that row's id."""
    known = TrustedSet(trusted, trusted_id or id_col, vector_col, **options)
    return known.score(candidates, vector_col, with_id)
