"""Removing word passages that an earlier document has as well, by super-k-mers.

A window is ``window`` consecutive words of one text. It has a minimiser: the smallest hash among
its runs of ``MGRAM`` words. Equal windows have equal minimisers, so they meet in one bucket:

1. *Shared minimisers.* Every minimiser is counted over all texts. Those that no second document has
   name no repeated window. The others are set in a bit table of fixed size, which every task gets; two
   minimisers that share a bit only let some windows travel in vain.
2. *Super-k-mers.* Consecutive windows with one minimiser travel as one packed string to its bucket.
   Equal strings are made one on the way, with the smallest and the largest id that hold them.
3. *Sorting.* A bucket sorts its windows, and the smallest id of equal ones goes back to their strings.
   Buckets of frequent minimisers are not sorted by one task: there every window goes to a place of its
   own by a 128-bit BLAKE2b digest, and Spark's aggregation finds its smallest id.

Strings that many documents hold are joined back by broadcast (at most ``HOT_KEYS`` of them).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanspark.llm.common import arrow_schema, join_by_frequency, map_rows, utf8
from gleanspark.storage import materialize

WINDOW = 50
# Words of a minimiser; a power of two.
MGRAM = 16
# Windows of one packed string.
MOST_WINDOWS = 64
# Bits of the tables of shared and of frequent minimisers: 16 MB and 512 KB.
SHARED_BITS = 27
FREQUENT_BITS = 22
# Bucket rows that one task sorts at most.
BUCKET_ROWS = 2000
# Words held at a time; longer texts are cut with an overlap of a window.
CHUNK = 1 << 18
# Packed strings whose windows are handed on at a time.
STRINGS = 1 << 10

FIRSTS = "digest binary, firsts array<struct<low: int, high: int, first: bigint>>"


def digest_of(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def minimisers(hashes: np.ndarray, window: int, mgram: int) -> np.ndarray:
    """The smallest hash of ``mgram`` words in the window that starts at each word."""
    grams, step = hashes, 1
    while step < mgram:
        grams = (grams[:-step] * np.uint64(0x9E3779B97F4A7C15) + grams[step:]) * np.uint64(0xD6E8FEB86659FD93)
        grams ^= grams >> np.uint64(32)
        step *= 2
    wide, least, step = window - mgram + 1, grams, 1
    while 2 * step <= wide:
        least, step = np.minimum(least[:-step], least[step:]), 2 * step
    return np.minimum(least[: len(least) - (wide - step)], least[wide - step :])


def pieces(texts: Iterable[bytes], window: int) -> Iterator[list[tuple[int, int, list[bytes]]]]:
    """Lists of (row, number of the first word, words) of about ``CHUNK`` words, no window cut."""
    held, size = [], 0
    for row, text in enumerate(texts):
        words = text.split()
        for start in range(0, max(1, len(words) - window + 1), CHUNK):
            part = words[start : start + CHUNK + window - 1]
            if len(part) >= window:
                held.append((row, start, part))
                size += len(part)
            if size >= CHUNK:
                yield held
                held, size = [], 0
    if held:
        yield held


def super_kmers(part: list[tuple[int, int, list[bytes]]], window: int, mgram: int):
    """(words, row, first word's number, place, windows, minimiser) of every run of windows."""
    words = [w for _, _, ws in part for w in ws]
    sizes = np.array([len(ws) for _, _, ws in part])
    ends = np.cumsum(sizes)
    piece = np.repeat(np.arange(len(part)), sizes)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    least = minimisers(hashes, window, mgram)
    place = np.flatnonzero(piece[: len(least)] == piece[window - 1 :])
    new = np.ones(len(place), dtype=bool)
    new[1:] = (least[place[1:]] != least[place[:-1]]) | (piece[place[1:]] != piece[place[:-1]])
    first = np.flatnonzero(new)
    run = np.cumsum(new) - 1
    new |= (np.arange(len(place)) - first[run]) % MOST_WINDOWS == 0
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(place)))
    at = place[first]
    rows = np.array([r for r, _, _ in part])[piece[at]]
    numbers = at - (ends - sizes)[piece[at]] + np.array([s for _, s, _ in part])[piece[at]]
    return words, rows, numbers, at, count, least[at].view(np.int64)


def bit_table(hashes: DataFrame, bits: int) -> np.ndarray:
    """The bits of all ``hash`` values; the driver holds the table and nothing else."""
    slot = F.shiftrightunsigned(F.col("hash"), 64 - bits) + 1
    chunks = hashes.groupBy(F.bitmap_bucket_number(slot).alias("chunk")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits")
    )
    found = np.zeros((1 << bits) // 8, dtype=np.uint8)
    for row in chunks.collect():
        start = (row.chunk - 1) * len(row.bits)
        found[start : start + len(row.bits)] = np.frombuffer(row.bits, dtype=np.uint8)
    return found


def is_set(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes.view(np.uint64) >> np.uint64(64 - (len(table).bit_length() + 2))
    return (table[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def of_two_documents() -> Column:
    """Of an aggregation with low, high and nameless: a later document repeats an earlier one."""
    return (F.col("low") < F.col("high")) | (F.col("low").isNotNull() & (F.col("nameless") > 0))


def holders(doc: str = "doc") -> list[Column]:
    return [F.min(doc).alias("low"), F.max(doc).alias("high"), F.count_if(F.col(doc).isNull()).alias("nameless")]


def counted_minimisers(rows: DataFrame, window: int, mgram: int) -> DataFrame:
    """(hash, low, high, nameless, n) of every minimiser of ``rows(doc, print, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(utf8(batch.column("text")), window):
                _, at, _, _, _, hashes = super_kmers(part, window, mgram)
                yield pa.RecordBatch.from_arrays([pa.array(hashes), batch.column("doc").take(at)], ["hash", "doc"])

    found = rows.select("doc", "text").mapInArrow(run, "hash bigint, doc bigint")
    return found.groupBy("hash").agg(*holders(), F.count(F.lit(1)).alias("n"))


def packed(rows: DataFrame, shared: np.ndarray, frequent: np.ndarray, window: int, mgram: int) -> DataFrame:
    """The super-k-mers whose minimiser is shared, with their place in the text."""
    tables = rows.sparkSession.sparkContext.broadcast((shared, frequent))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared, frequent = tables.value
        for batch in batches:
            for part in pieces(utf8(batch.column("text")), window):
                words, row, number, at, count, hashes = super_kmers(part, window, mgram)
                keep = np.flatnonzero(is_set(shared, hashes))
                if not len(keep):
                    continue
                strings = [b" ".join(words[a : a + n + window - 1]) for a, n in zip(at[keep], count[keep])]
                columns = {
                    "doc": batch.column("doc").take(row[keep]), "print": batch.column("print").take(row[keep]),
                    "number": pa.array(number[keep]), "hash": pa.array(hashes[keep]),
                    "frequent": pa.array(is_set(frequent, hashes[keep])),
                    "digest": pa.array(list(map(digest_of, strings)), pa.binary()),
                    "packed": pa.array(strings, pa.binary()),
                }
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    schema = "doc bigint, print bigint, number bigint, hash bigint, frequent boolean, digest binary, packed binary"
    return rows.select("doc", "print", "text").mapInArrow(run, schema)


def windows_of(string: bytes, window: int) -> list[bytes]:
    """The windows of a packed string; its words are joined by single blanks."""
    blanks = [-1, *np.flatnonzero(np.frombuffer(string, dtype=np.uint8) == 32).tolist(), len(string)]
    return [string[blanks[i] + 1 : blanks[i + window]] for i in range(len(blanks) - window)]


def sorted_bucket(strings: list[bytes], lows: list[int | None], window: int) -> list[list[tuple[int, int]]]:
    """(window's number, smallest id) of the windows that some document holds, by string."""
    windows = [(w, k, i) for k, s in enumerate(strings) for i, w in enumerate(windows_of(s, window))]
    windows.sort()
    found: list[list[tuple[int, int]]] = [[] for _ in strings]
    for _, same in groupby(windows, key=lambda w: w[0]):
        same = list(same)
        first = min((lows[k] for _, k, _ in same if lows[k] is not None), default=None)
        if first is not None:
            for _, k, i in same:
                found[k].append((i, first))
    return found


def in_ranges(found: list[tuple[int, int]], high: int | None, nameless: int) -> list[dict]:
    """Runs of windows with one smallest id, if some holder of the string comes after it."""
    ranges: list[dict] = []
    for i, first in sorted(found):
        if not nameless and first >= high:
            continue
        if ranges and ranges[-1]["high"] == i - 1 and ranges[-1]["first"] == first:
            ranges[-1]["high"] = i
        else:
            ranges.append({"low": i, "high": i, "first": first})
    return ranges


def firsts_by_sorting(strings: DataFrame, window: int) -> DataFrame:
    """(digest, firsts) of the buckets that one task sorts."""

    schema = arrow_schema(strings.sparkSession, FIRSTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def answer(bucket: list[tuple]) -> list[dict]:
            found = sorted_bucket([r[1] for r in bucket], [r[3] for r in bucket], window)
            out = [
                {"digest": digest, "firsts": in_ranges(one, high, nameless)}
                for (_, _, digest, _, high, nameless), one in zip(bucket, found)
            ]
            return [r for r in out if r["firsts"]]

        names, rest = ("hash", "packed", "digest", "low", "high", "nameless"), []
        for batch in batches:
            out = []
            for row in zip(*(batch.column(n).to_pylist() for n in names)):
                if rest and rest[0][0] != row[0]:
                    out += answer(rest)
                    rest = []
                rest.append(row)
            yield pa.RecordBatch.from_pylist(out, schema)
        if rest:
            yield pa.RecordBatch.from_pylist(answer(rest), schema)

    ordered = strings.repartition("hash").sortWithinPartitions("hash")
    return ordered.mapInArrow(run, FIRSTS)


def firsts_by_digest(strings: DataFrame, window: int) -> DataFrame:
    """(digest, firsts) of the buckets of frequent minimisers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, STRINGS):
                part = batch.slice(start, STRINGS)
                inner = [list(map(digest_of, windows_of(s, window))) for s in part.column("packed").to_pylist()]
                sizes = [len(one) for one in inner]
                held = part.select(["digest", "low", "high", "nameless"]).take(np.repeat(np.arange(len(sizes)), sizes))
                at = pa.array(chain.from_iterable(map(range, sizes)), pa.int32())
                windows = pa.array(chain.from_iterable(inner), pa.binary())
                arrays = [*held.columns, at, windows]
                yield pa.RecordBatch.from_arrays(arrays, [*held.schema.names, "at", "window"])

    schema = "digest binary, low bigint, high bigint, nameless bigint, at int, window binary"
    kept = strings.select("packed", "digest", "low", "high", "nameless")
    windows = materialize(kept.mapInArrow(run, schema), "substring-windows")
    counts = windows.groupBy("window").agg(
        F.min("low").alias("low"), F.max("high").alias("high"), F.sum("nameless").alias("nameless"),
        F.count(F.lit(1)).alias("n"),
    )
    counts = materialize(counts.filter(of_two_documents()), "substring-frequent")
    few = counts.select("window", F.col("low").alias("first"))
    met = join_by_frequency(windows.select("window", "digest", "at", "high", "nameless"), few, counts, "window")
    met = met.filter((F.col("nameless") > 0) | (F.col("first") < F.col("high")))
    one = F.struct(F.col("at").alias("low"), F.col("at").alias("high"), "first")
    return met.groupBy("digest").agg(F.collect_list(one).alias("firsts"))


def repeats(rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc, print, ranges): the words of ``rows(doc, print, text)`` that a smaller ``doc`` has too.

    ``ranges`` are pairs of word numbers, the end exclusive; they may overlap.
    """
    mgram = 1 << (min(MGRAM, window).bit_length() - 1)
    grams = materialize(
        counted_minimisers(rows, window, mgram).filter(of_two_documents()).select("hash", "n"), "substring-shared"
    )
    shared = bit_table(grams, SHARED_BITS)
    frequent = bit_table(grams.filter(F.col("n") > BUCKET_ROWS), FREQUENT_BITS)
    found = materialize(packed(rows, shared, frequent, window, mgram), "substring-packed")
    strings = found.groupBy("hash", "frequent", "digest", "packed").agg(*holders(), F.count(F.lit(1)).alias("n"))
    strings = materialize(strings, "substring-strings")
    firsts = firsts_by_sorting(strings.filter("NOT frequent"), window).unionByName(
        firsts_by_digest(strings.filter("frequent"), window)
    )
    firsts = materialize(firsts, "substring-firsts")
    places = found.select("digest", "doc", "print", "number")
    met = join_by_frequency(places, firsts, strings.select("digest", "n"), "digest")
    later = F.filter("firsts", lambda f: F.col("doc").isNull() | (f["first"] < F.col("doc")))
    ranges = F.transform(
        later,
        lambda f: F.struct(
            (F.col("number") + f["low"]).alias("start"), (F.col("number") + f["high"] + window).alias("stop")
        ),
    )
    met = met.select("doc", "print", ranges.alias("ranges")).filter(F.size("ranges") > 0)
    return met.groupBy("doc", "print").agg(F.flatten(F.collect_set("ranges")).alias("ranges"))


def deduplicated(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW
) -> DataFrame:
    """``docs`` with each text cut down to the words that no document with a smaller id repeats.

    A word goes if a window of ``window`` words covers it whose words also start somewhere in a
    document with a smaller id; all windows are judged on the texts as they came. The words left are
    joined by single blanks. ``n_words`` and ``n_removed`` are added (columns of these names are
    replaced), all other columns stay as they are. A NULL text has no words and becomes the empty
    text. Ids are whole numbers; rows that share an id do not repeat each other, and a NULL id counts
    as larger than all others, so such rows repeat whatever has an id but nothing among themselves.
    """
    whole = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col(id_col).cast("bigint").alias("doc"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    ).withColumn("print", F.xxhash64("text"))
    found = materialize(repeats(whole.select("doc", "print", "text"), window), "substring-ranges")
    same = whole["doc"].eqNullSafe(found["doc"]) & (whole["print"] == found["print"])
    met = whole.join(found, same, "left").select("row", whole["text"], "ranges")

    def work():
        def step(batch: pa.RecordBatch) -> dict[str, Iterable]:
            out: dict[str, list] = {"kept": [], "n_words": [], "n_removed": []}
            for text, ranges in zip(utf8(batch.column("text")), batch.column("ranges").to_pylist()):
                words = text.split()
                edges = np.zeros(len(words) + 1, dtype=np.int64)
                for r in ranges or ():
                    edges[r["start"]] += 1
                    edges[r["stop"]] -= 1
                stays = np.cumsum(edges)[:-1] == 0
                kept = [words[i] for i in np.flatnonzero(stays)] if ranges else words
                out["kept"].append(b" ".join(kept).decode())
                out["n_words"].append(len(words))
                out["n_removed"].append(len(words) - len(kept))
            return out

        return step

    cut = map_rows(met, work, "kept string, n_words bigint, n_removed bigint", keep=["row"])
    new = {text_col: F.col("kept")}
    own = [new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns if c not in ("n_words", "n_removed")]
    return cut.select(*own, "n_words", "n_removed")
