"""Texts that hold a benchmark item, up to a share of edits.

An item of length m may differ in k = share * m edits. It is cut into k + 1 pieces; where the item
occurs with at most k edits, one piece is left whole. All pieces are searched at once, every
hit opens a stretch in which the item may lie. An edit touches at most q of the item's q-grams, so
a stretch that lacks too many of them is left out; for the others Myers' bit-parallel distance
decides.

The items are taken in blocks of bounded size, each block in one pass over the texts, so what is
sent to the executors does not grow with the benchmark.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanspark.llm.common import map_rows, shelters

ERROR_SHARE = 0.1
BLOCK_BYTES = 1 << 20
GRAM = 4


def plain(text: str | None) -> str:
    """Lower case, words joined by one blank."""
    return " ".join((text or "").lower().split())


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """``budget + 1`` pieces with their offsets; lengths differ by one at most."""
    edges = [len(item) * i // (budget + 1) for i in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(edges, edges[1:])]


def distance_in(peq: dict[str, int], length: int, text: str) -> tuple[int, int]:
    """Fewest edits that turn some stretch of ``text`` into the item, and where it ends first.

    ``peq`` holds for each letter the bits of its places in the item.
    """
    every, top = (1 << length) - 1, 1 << (length - 1)
    plus, minus, score = every, 0, length
    best, end = length, 0
    get = peq.get
    for at, letter in enumerate(text, 1):
        eq = get(letter, 0)
        across = ((((eq & plus) + plus) ^ plus) | eq) & every
        up = minus | (~(across | plus) & every)
        down = plus & across
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up = (up << 1) & every
        down = (down << 1) & every
        plus = down | (~(eq | minus | up) & every)
        minus = up & (eq | minus)
        if score < best:
            best, end = score, at
    return best, end


class ItemIndex:
    """Pieces of a block of items."""

    def __init__(self, items: list[tuple[object, str]], share: float):
        self.items = []
        found = defaultdict(list)
        for item_id, text in items:
            if not (text := plain(text)):
                continue
            budget = int(share * len(text))
            places = defaultdict(int)
            for at, letter in enumerate(text):
                places[letter] |= 1 << at
            for offset, piece in pieces(text, budget):
                found[piece].append((len(self.items), offset))
            grams = [text[i : i + GRAM] for i in range(len(text) - GRAM + 1)]
            self.items.append((item_id, text, budget, dict(places), grams))
        self.automaton = ahocorasick.Automaton()
        for piece, where in found.items():
            self.automaton.add_word(piece, (len(piece), where))
        if self.items:
            self.automaton.make_automaton()

    def matches(self, text: str | None) -> Iterator[tuple[object, int, int]]:
        """(item, edits, end) of every item the text holds; ``end`` counts in the plain text."""
        if not self.items or not (text := plain(text)):
            return
        stretches: dict[int, list[list[int]]] = {}
        for last, (size, where) in self.automaton.iter(text):
            for number, offset in where:
                _, item, budget, _, _ = self.items[number]
                low = last + 1 - size - offset - budget
                high = low + len(item) + 2 * budget
                known = stretches.setdefault(number, [])
                if known and low <= known[-1][1]:
                    known[-1][0] = min(known[-1][0], low)
                    known[-1][1] = max(known[-1][1], high)
                else:
                    known.append([low, high])
        for number in sorted(stretches):
            item_id, item, budget, places, grams = self.items[number]
            needed = len(grams) - GRAM * budget
            best, end = budget + 1, 0
            for low, high in stretches[number]:
                low = max(low, 0)
                stretch = text[low:high]
                if sum(map(stretch.__contains__, grams)) < needed:
                    continue
                edits, at = distance_in(places, len(item), stretch)
                if edits < best:
                    best, end = edits, low + at
            if best <= budget:
                yield item_id, best, end


def blocks(items: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[list]:
    """The items in blocks of about ``block_bytes``; each is on the driver for itself alone."""
    rows = items.select(F.col(id_col).cast("bigint").alias("item"), F.col(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = size // block_bytes + 1
    for number in range(count):
        part = rows.filter(F.pmod(F.xxhash64("item", "text"), F.lit(count)) == number)
        found = [tuple(r) for r in part.collect()]
        yield sorted(found, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))


def with_matches(
    docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id",
    item_text: str = "text", share: float = ERROR_SHARE, block_bytes: int = BLOCK_BYTES,
    name: str = "leaks",
) -> DataFrame:
    """``docs`` with ``leaks``: array of (item_id, edits, match_end), empty for a clean text.

    No text and no item that is NULL or blank matches. Items of the same text or id all match.
    """
    schema = f"{name} array<struct<item_id: bigint, edits: int, match_end: int>>"
    fields, found = ("item_id", "edits", "match_end"), docs
    for number, block in enumerate(blocks(items, item_id, item_text, block_bytes)):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def work(shared=shared, first=number == 0):
            index = ItemIndex(shared.value, share)

            def step(batch: pa.RecordBatch) -> dict:
                texts = batch.column(text_col)
                new = [[dict(zip(fields, m)) for m in index.matches(t.as_py())] for t in texts]
                if not first:
                    new = [a + b for a, b in zip(batch.column(name).to_pylist(), new)]
                return {name: new}

            return step

        found = map_rows(found, work, schema)
    return found


def contaminated(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options
) -> DataFrame:
    """(id, item_id, edits, match_end): a row for every row of ``docs`` and item it holds."""
    plain_docs = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    found = with_matches(plain_docs, items, **options)
    return found.select(F.col("doc").alias(id_col), F.inline("leaks"))


@shelters
def decontaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that hold no item, as they are."""
    found = with_matches(docs, items, text_col, name="__leaks", **options)
    return found.filter(F.size("__leaks") == 0).drop("__leaks")
