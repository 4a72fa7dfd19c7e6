"""Stretches of words that repeat with a period, by seeds on diagonals.

A run of period q is found on the diagonal "word i equals word i + q". Periods are taken by powers of
two: for q from 2^j up to 2^(j+1) a run of at least four periods matches itself over at least 3 * 2^j
words at lag q (over 5 words for q = 1), so some k-gram of that guaranteed length occurs twice, q apart.

1. *Index.* k-grams are numbered exactly, a level from the level below, for all texts of a batch at
   once. A k-gram that its text holds once has no part in longer seeds, so the levels shrink fast.
2. *Pairs.* Each occurrence is paired with the next one of its text. The seed is longer than the
   period, so inside a run the next occurrence is exactly one period away, and no other pair is needed.
3. *Extension.* A pair is extended along its diagonal to both sides. A table keeps for every lag of a
   text how far it has been covered, and pairs below that are passed over.

Texts do not meet each other, so no row is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanspark.llm.common import map_rows, utf8

LEAST_PERIODS = 4
LEAST_LENGTH = 6
# Words of short texts looked at together; a longer text is looked at alone.
CHUNK = 1 << 19

RUNS = "runs array<struct<start: bigint, length: bigint, period: bigint>>"


def numbered(keys: np.ndarray) -> np.ndarray:
    """Equal keys get equal numbers from 0 on."""
    return np.unique(keys, return_inverse=True)[1].astype(np.int64)


def joined(ranks: np.ndarray, at: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Places whose rank and the rank ``step`` further are both known, with numbers of the pairs."""
    at = at[at + step < len(ranks)]
    at = at[ranks[at + step] >= 0]
    return at, numbered(ranks[at] * len(ranks) + ranks[at + step])


def next_pairs(at: np.ndarray, number: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(lag, place) of k-grams that come again at ``low`` to ``high`` - 1 words, by lag and place."""
    order = np.argsort(number, kind="stable")
    at, number = at[order], number[order]
    lag = np.diff(at)
    kept = (number[1:] == number[:-1]) & (lag >= low) & (lag < high)
    at, lag = at[:-1][kept], lag[kept]
    order = np.lexsort((at, lag))
    return lag[order], at[order]


def extended(ids: np.ndarray, start: int, stop: int, place: int, lag: int) -> tuple[int, int]:
    """The stretch of words from ``start`` to ``stop`` around ``place`` that keeps the period."""
    step, left = 64, place
    while left > start:
        low = max(start, left - step)
        unlike = np.flatnonzero(ids[low:left] != ids[low + lag : left + lag])
        if len(unlike):
            left = low + int(unlike[-1]) + 1
            break
        left, step = low, 2 * step
    step, right = 64, place
    while right + lag < stop:
        high = min(stop - lag, right + step)
        unlike = np.flatnonzero(ids[right:high] != ids[right + lag : high + lag])
        if len(unlike):
            right += int(unlike[0])
            break
        right, step = high, 2 * step
    return left, right + lag


def runs_of(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each text, by start and period."""
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    ends = np.cumsum(sizes)
    total = int(sizes.sum())
    names: dict[bytes, int] = {}
    words = np.fromiter((names.setdefault(w, len(names)) for t in texts for w in t), np.int64, total)
    text = np.repeat(np.arange(len(texts)), sizes)
    # Words of different texts differ, so nothing reaches over the end of a text.
    ids = numbered(text * max(1, len(names)) + words)
    ranks, at, width = ids, np.arange(total), 1

    def repeated(at: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        kept = np.bincount(number)[number] > 1 if len(at) else np.zeros(0, dtype=bool)
        return at[kept], number[kept]

    def spread(at: np.ndarray, number: np.ndarray) -> np.ndarray:
        whole = np.full(total, -1, dtype=np.int64)
        whole[at] = number
        return whole

    def doubled() -> None:
        nonlocal ranks, at, width
        at, number = repeated(*joined(ranks, at, width))
        ranks, width = spread(at, number), 2 * width

    covered: dict[tuple[int, int], int] = {}
    doubled(), doubled()
    low = 1
    while len(at) and LEAST_PERIODS * low <= sizes.max(initial=0):
        # Ranks are of 4 words for period 1 and of 2 * low words beyond.
        if low > 1 and width < 2 * low:
            doubled()
        seed = 5 if low == 1 else 3 * low
        lags, places = next_pairs(*joined(ranks, at, seed - width), low, 2 * low)
        for lag, place in zip(lags.tolist(), places.tolist()):
            k = int(text[place])
            if place < covered.get((k, lag), 0):
                continue
            first = int(ends[k] - sizes[k])
            start, stop = extended(ids, first, int(ends[k]), place, lag)
            covered[k, lag] = stop - lag
            if stop - start >= max(LEAST_LENGTH, LEAST_PERIODS * lag):
                found[k].append((start - first, stop - start, lag))
        low *= 2
    return [sorted(runs, key=lambda r: (r[0], r[2])) for runs in found]


def collapsed(words: list[bytes], runs: Iterable[tuple[int, int, int]]) -> bytes:
    """The words without those that a run holds behind its first period."""
    edges = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(edges)[:-1] == 0)])


def in_portions(texts: Iterator[bytes]) -> Iterator[list[list[bytes]]]:
    held, size = [], 0
    for text in texts:
        words = text.split()
        if held and size + len(words) > CHUNK:
            yield held
            held, size = [], 0
        held.append(words)
        size += len(words)
    if held:
        yield held


def with_runs(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_words``, ``runs`` and ``collapsed``; columns of these names are replaced.

    A run is a stretch of words of smallest period q, of at least four periods and six words, that
    neither neighbour extends. ``runs`` are ordered by start, then period; ``collapsed`` is the text
    without the words that some run holds behind its first q words, joined by single blanks. A NULL,
    empty or blank text has no words, no runs and the empty text. Every row is looked at by itself,
    whatever its id; repeated rows stay.
    """

    def work():
        def step(batch: pa.RecordBatch) -> dict[str, Iterable]:
            out: dict[str, list] = {"n_words": [], "runs": [], "collapsed": []}
            for texts in in_portions(utf8(batch.column(text_col))):
                for words, runs in zip(texts, runs_of(texts)):
                    out["n_words"].append(len(words))
                    out["runs"].append([dict(zip(("start", "length", "period"), r)) for r in runs])
                    out["collapsed"].append((collapsed(words, runs) if runs else b" ".join(words)).decode())
            return out

        return step

    return map_rows(docs, work, f"n_words bigint, {RUNS}, collapsed string")


def planted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with a repeated stretch put into the texts that a hash of the id picks out.

    With h the crc32 of the id as text and g a tenth of it: where h % 10 is 0, word i from a = g % n on
    becomes word a + (i - a) % p, p = 1 + (n - a) / (3 + g % 8). Words of other texts stay as they are.
    Rows without an id are left alone.
    """
    hashed = F.crc32(F.col(id_col).cast("string"))

    def work():
        def step(batch: pa.RecordBatch) -> dict[str, Iterable]:
            out = []
            for text, h in zip(utf8(batch.column(text_col)), batch.column("__hash").to_pylist()):
                words = text.split() if h is not None and h % 10 == 0 else []
                if words:
                    g, n = h // 10, len(words)
                    a = g % n
                    p = 1 + (n - a) // (3 + g % 8)
                    text = b" ".join(words[:a] + [words[a + (i - a) % p] for i in range(a, n)])
                out.append(text.decode())
            return {text_col: out}

        return step

    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), text_col, hashed.alias("__hash"))
    changed = map_rows(whole, work, f"`{text_col}` string", keep=["row"])
    own = [F.col(text_col) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns]
    return changed.select(*own)


def strongest(runs: Column) -> Column:
    """The run with the greatest length by period; of equal ones that with the least start, then period."""

    def compare(a: Column, b: Column) -> Column:
        mine, other = a["length"] * b["period"], b["length"] * a["period"]
        earlier = (a["start"] < b["start"]) | ((a["start"] == b["start"]) & (a["period"] < b["period"]))
        return F.when(mine > other, -1).when(mine < other, 1).when(earlier, -1).otherwise(1)

    return F.get(F.array_sort(runs, compare), F.lit(0))
