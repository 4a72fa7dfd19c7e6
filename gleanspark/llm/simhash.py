"""Near duplicates by SimHash and a hierarchical index in Gray order.

Every text gets a 64-bit fingerprint. Two fingerprints link when they differ in at most
``distance`` bits, and linked texts form components. The search never compares all pairs:

1. *Groups.* The bits are cut into ``distance + 1`` blocks; two fingerprints that link agree on
   a whole block, so every distinct fingerprint goes to one group per block. A group over
   ``GROUP_ROWS`` is cut again along the bits it does not share yet, as often as it takes. As the
   members are distinct, the bits left bound the size of the last groups.
2. *Index.* A group is sorted by Gray rank, in which neighbours differ in few bits. Runs of
   neighbours become nodes that hold the bits all members share; a node keeps only the bits its
   parent does not hold already. A search walks from the top, adds up the differing bits, and
   leaves out a node with all members once they exceed the distance.
3. *Components.* A group hands on one link per member at most (to the first of its component in
   the group). Stars of links are contracted in Spark until nothing changes.

Copies share a fingerprint and meet only in aggregations that combine before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, islice, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanspark.llm.common import join_by_frequency, map_rows, shelters, utf8
from gleanspark.storage import materialize

BITS = 64
DISTANCE = 2
SHINGLE = 3
SEED = 42
GROUP_ROWS = 1024
LEAF = 8
FAN_OUT = 8
# Shingles hashed at a time, which bounds the memory of a very long text.
CHUNK = 1 << 16
# Walks of the index kept at a time.
FRONTIER = 1 << 18

# Bit j of every byte value.
BYTE_BITS = (np.arange(256)[:, None] >> np.arange(8)[None, :]) & 1


def fingerprint(text: bytes) -> int:
    """A bit is set if it is set in over half the hashes of the text's shingles; 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles = iter([b" ".join(words)])
    else:
        shingles = map(b" ".join, zip(*(islice(words, i, None) for i in range(SHINGLE))))
    hashes = map(xxhash.xxh64_intdigest, shingles, repeat(SEED))
    total, counts = 0, np.zeros(8 * 256, dtype=np.int64)
    offsets = np.arange(8) * 256
    while len(part := np.fromiter(islice(hashes, CHUNK), dtype="<u8")):
        total += len(part)
        values = part.view(np.uint8).reshape(-1, 8) + offsets
        counts += np.bincount(values.ravel(), minlength=len(counts))
    ones = (counts.reshape(8, 256) @ BYTE_BITS).ravel()
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def with_fingerprint(
    docs: DataFrame, text_col: str = "text", name: str = "fp", keep: list[str] | None = None
) -> DataFrame:
    """``docs`` with the fingerprint of each text as a signed 64-bit number."""

    def work():
        def step(batch: pa.RecordBatch) -> dict:
            prints = [fingerprint(t) for t in utf8(batch.column(text_col))]
            return {name: np.array(prints, dtype=np.uint64).view(np.int64)}

        return step

    return map_rows(docs, work, f"{name} bigint", keep)


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), BITS // 4, "0"))


def gray_rank(prints: np.ndarray) -> np.ndarray:
    """Place of each fingerprint in the sequence of Gray codes."""
    rank = prints.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Nodes over fingerprints in Gray order; level 0 are the fingerprints themselves."""

    def __init__(self, prints: np.ndarray):
        self.order = np.argsort(gray_rank(prints), kind="stable")
        every = ~np.uint64(0)
        ands = ors = prints[self.order]
        self.levels = [(ands, np.full(len(ands), every))]
        self.fan_outs, width = [], LEAF
        while len(ands) > 1:
            starts = np.arange(0, len(ands), width)
            ands, ors = np.bitwise_and.reduceat(ands, starts), np.bitwise_or.reduceat(ors, starts)
            shared = ~(ands ^ ors)
            self.levels.append((ands & shared, shared))
            self.fan_outs.append(width)
            width = FAN_OUT

    def pairs(self, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions (i, j), i before j in Gray order, that differ in at most ``distance`` bits."""
        prints = self.levels[0][0]
        top, (patterns, shared) = len(self.levels) - 1, self.levels[-1]
        per_step = max(1, FRONTIER // (LEAF * FAN_OUT * len(patterns)))
        for start in range(0, len(prints), per_step):
            queries = np.arange(start, min(start + per_step, len(prints)))
            at, node = np.repeat(queries, len(patterns)), np.tile(np.arange(len(patterns)), len(queries))
            apart = np.bitwise_count((prints[at] ^ patterns[node]) & shared[node])
            yield from self._down(top, at, node, apart, distance)

    def _down(self, level, at, node, apart, distance):
        near = apart <= distance
        at, node, apart = at[near], node[near], apart[near]
        if level == 0:
            later = node > at
            yield at[later], node[later]
            return
        width, (patterns, shared) = self.fan_outs[level - 1], self.levels[level - 1]
        held, prints = self.levels[level][1], self.levels[0][0]
        step = max(1, FRONTIER // width)
        for i in range(0, len(at), step):
            child = node[i : i + step, None] * width + np.arange(width)[None, :]
            inside = child < len(patterns)
            queries = np.broadcast_to(at[i : i + step, None], child.shape)[inside]
            parents = np.broadcast_to(node[i : i + step, None], child.shape)[inside]
            so_far = np.broadcast_to(apart[i : i + step, None], child.shape)[inside]
            child = child[inside]
            own = shared[child] & ~held[parents]
            more = np.bitwise_count((prints[queries] ^ patterns[child]) & own)
            yield from self._down(level - 1, queries, child, so_far + more, distance)


def merged(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (smallest position of the component) after linking positions a and b."""
    while True:
        low = np.minimum(labels[a], labels[b])
        before = labels.copy()
        np.minimum.at(labels, before[a], low)
        np.minimum.at(labels, before[b], low)
        while (labels[labels] != labels).any():
            labels = labels[labels]
        if (labels[a] == labels[b]).all():
            return labels


def group_links(prints: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Every member that links to another of its group, and the first of its component."""
    index = GrayIndex(prints)
    labels = np.arange(len(prints))
    for a, b in index.pairs(distance):
        if len(a):
            labels = merged(labels, a, b)
    inner = np.flatnonzero(labels != np.arange(len(labels)))
    ordered = index.levels[0][0]
    return ordered[inner], ordered[labels[inner]]


def signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def cuts(held: int, parts: int) -> list[int]:
    """``held`` with one more of ``parts`` equal blocks of the bits it lacks, for every block."""
    free = [i for i in range(BITS) if not held >> i & 1]
    edges = [round(len(free) * k / parts) for k in range(parts + 1)]
    blocks = [free[a:b] for a, b in zip(edges, edges[1:])]
    return [held | sum(1 << i for i in block) for block in blocks if block]


def in_groups(prints: DataFrame, distance: int, group_rows: int) -> DataFrame:
    """(held, value, fp): every fingerprint in groups of bounded size that keep all links."""
    parts = distance + 1

    def dealt(rows: DataFrame, masks: dict[int, list[int]], by: Column | None) -> DataFrame:
        if by is None:
            found = F.array(*[F.lit(signed(m)) for m in masks[0]])
        else:
            every = list(chain.from_iterable(
                (F.lit(signed(k)), F.array(*[F.lit(signed(m)) for m in v])) for k, v in masks.items()
            ))
            found = F.element_at(F.create_map(*every), by)
        rows = rows.select("fp", F.explode(found).alias("held"))
        return rows.select("held", F.col("fp").bitwiseAND(F.col("held")).alias("value"), "fp")

    level = {0: cuts(0, parts)}
    rows, done = dealt(prints, level, None), None
    while True:
        large = materialize(
            rows.groupBy("held", "value").count().filter(F.col("count") > group_rows), "simhash-large"
        )
        if large.isEmpty():
            return rows if done is None else done.unionByName(rows)
        keys = large.select("held", "value")
        small = rows.join(keys, ["held", "value"], "left_anti")
        done = small if done is None else done.unionByName(small)
        level = {m: cuts(m, parts) for masks in level.values() for m in masks}
        again = rows.join(keys, ["held", "value"], "left_semi")
        rows = dealt(again, level, F.col("held"))


def links(prints: DataFrame, distance: int = DISTANCE, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(u, v): links that connect the distinct fingerprints ``fp`` as all links together do."""
    rows = in_groups(prints, distance, max(group_rows, 1 << (distance + 1)))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def linked(fps):
            u, v = group_links(fps.view(np.uint64), distance)
            return pa.RecordBatch.from_arrays(
                [pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"]
            )

        rest = np.zeros((3, 0), dtype=np.int64)
        for batch in chain(batches, [None]):
            if batch is not None:
                columns = [batch.column(n).to_numpy(zero_copy_only=False) for n in ("held", "value", "fp")]
                rest = np.concatenate([rest, np.stack(columns)], axis=1)
            new = np.flatnonzero((np.diff(rest[:2], axis=1) != 0).any(axis=0)) + 1
            edges = np.concatenate([[0], new, [rest.shape[1]]])
            # The last group may go on in the next batch.
            whole = len(edges) - 1 if batch is None else len(edges) - 2
            for k in np.flatnonzero(np.diff(edges[: whole + 1]) > 1):
                out = linked(np.ascontiguousarray(rest[2, edges[k] : edges[k + 1]]))
                if out.num_rows:
                    yield out
            rest = rest[:, edges[whole] :]

    ordered = rows.repartition("held", "value").sortWithinPartitions("held", "value")
    return ordered.mapInArrow(find, "u bigint, v bigint").distinct()


def contracted(edges: DataFrame) -> DataFrame:
    """(u, root) for every u that is not the smallest of its component of ``edges(u, v)``.

    Each round hangs a node's larger neighbours, then its smaller ones, below the smallest; it
    ends when a round changes nothing. The rounds grow with the logarithm of the longest chain.
    """

    def hung(both: DataFrame) -> DataFrame:
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("root"))
        return both.join(least, "u")

    def state(df: DataFrame):
        return df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    turned = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    edges = materialize(edges.union(turned).filter("u > v").distinct(), "simhash-links")
    seen = state(edges)
    while seen[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = hung(both).filter("v > u").select(F.col("v").alias("u"), F.col("root").alias("v")).distinct()
        met = hung(large)
        small = met.select("u", F.col("root").alias("v")).union(
            met.select(F.col("v").alias("u"), F.col("root").alias("v"))
        )
        edges = materialize(small.filter("u > v").distinct(), "simhash-links")
        now = state(edges)
        if now == seen:
            break
        seen = now
    return edges.select("u", F.col("v").alias("root"))


def roots(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(fp, root) of the distinct fingerprints; the root names the component."""
    tied = contracted(links(prints.select("fp"), distance)).withColumnRenamed("u", "fp")
    return prints.join(tied, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE
) -> DataFrame:
    """(id, fingerprint, component_id) of every row of ``docs``.

    The component's id is its smallest id. NULL, empty and blank texts have fingerprint zero and
    link like any other; repeated rows stay; a NULL id is kept, and names a component only if no
    member has an id. Other columns of ``docs`` are not read.
    """
    plain = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    rows = materialize(with_fingerprint(plain, keep=["doc"]), "simhash-prints")
    prints = materialize(rows.groupBy("fp").agg(F.min("doc").alias("first")), "simhash-distinct")
    rooted = materialize(roots(prints), "simhash-roots")
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    by_print = materialize(rooted.join(named, "root").select("fp", "component_id"), "simhash-named")
    return rows.join(by_print, "fp").select(
        F.col("doc").alias(id_col), hexadecimal(F.col("fp")).alias("fingerprint"), "component_id"
    )


def one_per_root(
    printed: DataFrame, rows: DataFrame, rooted: DataFrame, id_col: str, own: str
) -> DataFrame:
    """The rows of ``printed`` with the smallest id of each root, NULL last, without the column ``own``.

    ``own`` is the fingerprint of a row, ``rows(doc, fp)`` holds all of them and ``rooted(fp, root)``
    their roots. Of rows that agree in id and fingerprint, any one stays. Only the rows to drop travel
    to the texts.
    """
    rooted = materialize(rooted, "dedup-roots")
    copies = materialize(rows.groupBy("doc", "fp").count(), "dedup-copies")
    met = join_by_frequency(copies, rooted, copies.groupBy("fp").agg(F.count(F.lit(1)).alias("n")), "fp")
    met = materialize(met, "dedup-met")
    place = F.struct(F.col("doc").isNull(), "doc", "fp")
    first = met.groupBy("root").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
    first = materialize(first, "dedup-first")
    judged = join_by_frequency(met, first.drop("n"), first.select("root", "n"), "root")
    judged = judged.withColumn("stays", F.col("first") == place)
    keys = F.col("doc").alias("__doc"), F.col("fp").alias("__print")
    same = printed[id_col].eqNullSafe(F.col("__doc")) & (F.col(own) == F.col("__print"))
    dropped = materialize(judged.filter("NOT stays").select(*keys), "dedup-dropped")
    kept = printed.join(dropped, same, "left_anti")
    many = materialize(judged.filter("stays AND count > 1").select(*keys), "dedup-repeated")
    if not many.isEmpty():
        repeated = kept.join(many, same, "left_semi").dropDuplicates([id_col, own])
        kept = kept.join(many, same, "left_anti").unionByName(repeated)
    return kept.drop(own)


@shelters
def deduplicated(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE
) -> DataFrame:
    """One row of each component: that with the smallest id, NULL last; all columns as they are."""
    own = "__fp"
    printed = with_fingerprint(docs, text_col, own)
    rows = materialize(
        with_fingerprint(docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")), keep=["doc"]),
        "dedup-prints",
    )
    prints = materialize(rows.select("fp").distinct(), "dedup-distinct")
    return one_per_root(printed, rows, roots(prints, distance), id_col, own)
