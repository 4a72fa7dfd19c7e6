"""Exact top-k search by BM25 with an inverted index in shards.

*Index.* Every task turns its texts into shards of bounded size, one row each: the words, and for
each word the list of its texts with their counts. Equal texts of a shard share their entries. Texts
of a shard are dealt to groups by the frequent words they have, and neighbours in a group have the same
ones, so that the maxima of the lists over blocks of texts say something. Document counts and lengths are
summed over all shards, so all shards score with the same statistics.

*Search.* Queries come in blocks of bounded size, in groups made as those of the texts; a task takes a block
through its shards one after the other. As in WAND, a threshold (the k-th best score a query has, carried
from shard to shard) stands against what a text can reach: the lists of a query's rarer words, which add
most, are summed by text; the words split off for a group of queries, whose lists are long and add little,
are bounded by the maxima of their lists in each block of texts. Queries and blocks that can't pass are
skipped. For the others of a group of texts the long lists are summed for some hundred queries at a time,
as a product of matrices in single precision that has the words of this group only, and what may still
pass the threshold, by more than the rounding, is scored in full. The k best of each task meet in Spark,
k rows per task and query.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanspark.llm.common import BLANKS, utf8
from gleanspark.storage import materialize

K1, B = 1.2, 0.75
TOP = 10
# Words of the texts in a shard, and texts of a block whose maxima are kept.
SHARD_WORDS = 2_000_000
BLOCK_TEXTS = 32
# Distinct words of all queries that meet the shards at once, and bytes of their texts.
QUERY_WORDS = 4_000_000
QUERY_BYTES = 1 << 26
# Scores closer than this count as equal; the smaller id wins.
DIGITS = 9
SLACK = 1e-6
# Words whose presence orders the texts of a shard and the queries of a block, and those that make groups.
ORDER_WORDS, GROUP_WORDS = 64, 256
# Texts and queries of a group, the most groups of a shard or a block, rows and rounds that fit the groups.
GROUP_TEXTS, GROUP_QUERIES, GROUPS, FIT_ROWS, FIT_ROUNDS = 400, 1000, 64, 4096, 10
# A word is split off where it is in this share of all pairs of a query of a group and a text of the shard;
# then a product of matrices takes less time than its list.
SPLIT_SHARE = 0.001
# Numbers in the matrix of the words split off, in the sums of the queries worked on at once, in the
# table of their words, and entries of lists taken at once.
MATRIX, SUMS, MEMBERS, ENTRIES = 1 << 22, 1 << 19, 1 << 23, 1 << 16
# Tasks for each core that take the queries through the shards; with fewer, a threshold has seen more shards.
TASKS = 1
# Odd factors of the hash of a word.
FACTORS = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93

INDEX = (
    "doc_ids binary, has_id binary, doc_start binary, lengths binary, groups binary, words binary, sizes binary, found binary, "
    "texts binary, times binary, n_texts bigint, n_words bigint"
)
KINDS = {1: np.uint8, 2: np.uint16, 4: np.uint32}


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()


def smallest(values: np.ndarray) -> np.ndarray:
    """The values, none negative, as the smallest integers that hold them."""
    return values.astype(np.min_scalar_type(int(values.max(initial=0))))


def alike(owner: np.ndarray, words: np.ndarray, rows: int, per_group: int, kinds: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of ``rows`` rows in which those with the same frequent words come together, and where its groups start.

    ``words``, numbered below ``kinds``, are those of the rows ``owner``.
    """
    asked = max(ORDER_WORDS, min(GROUP_WORDS, MATRIX // max(1, rows)))
    often = np.argsort(-np.bincount(words, minlength=kinds), kind="stable")[:asked]
    rank = np.full(kinds, -1, np.int16)
    rank[often] = np.arange(len(often))
    has = np.zeros((rows, max(1, len(often))), bool)
    of_word = rank[words]
    hits = np.flatnonzero(of_word >= 0)
    has[owner[hits], of_word[hits]] = True
    packed = np.zeros((rows, 8), np.uint8)
    bits = np.packbits(has[:, :64], axis=1)
    packed[:, : bits.shape[1]] = bits
    packed = packed.view(">u8").ravel()
    # Groups by k-means, fitted on some of the rows; a rare word weighs more.
    fit = np.arange(0, rows, -(-rows // FIT_ROWS) or 1)
    groups = max(1, min(GROUPS, rows // per_group, len(fit)))
    group = np.zeros(rows, np.int64)
    if groups > 1:
        weight = np.sqrt(np.log1p(rows / np.maximum(1, has.sum(axis=0)))).astype(np.float32)
        nearest = lambda x: (x @ centres.T - (centres * centres).sum(axis=1) / 2).argmax(axis=1)
        x = has[fit] * weight
        centres = x[np.argsort(packed[fit], kind="stable")[(2 * np.arange(groups) + 1) * len(fit) // (2 * groups)]]
        for _ in range(FIT_ROUNDS):
            near = np.eye(groups, dtype=np.float32)[nearest(x)]
            size = near.sum(axis=0)
            centres = np.where(size[:, None] > 0, (near.T @ x) / np.maximum(1, size)[:, None], centres)
        for low in range(0, rows, FIT_ROWS):
            group[low : low + FIT_ROWS] = nearest(has[low : low + FIT_ROWS] * weight)
    return np.lexsort((packed, group)), starts_of(np.bincount(group, minlength=groups))


def starts_of(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def ranges(starts: np.ndarray, lists: np.ndarray) -> np.ndarray:
    """Positions of the entries of ``lists``, one list after the other."""
    low, size = starts[lists], starts[lists + 1] - starts[lists]
    at = np.repeat(low - np.cumsum(size, dtype=starts.dtype) + size, size)
    at += np.arange(len(at), dtype=starts.dtype)
    return at


def digests(joined: bytes, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash and length of each word, and the words in pieces of eight bytes (where each word's start, the pieces)."""
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(0, np.uint64)
    text = np.frombuffer(bytes(joined) + b"\n" + bytes(8), np.uint8)
    ends = np.flatnonzero(text[:-8] == 10)
    first = np.concatenate([[0], ends[:-1] + 1])
    length = ends - first
    size = (length + 7) >> 3
    start = starts_of(size)
    place = np.arange(start[-1]) - np.repeat(start[:-1], size)
    piece = np.ndarray((len(text) - 7,), "<u8", text, 0, (1,))[np.repeat(first, size) + 8 * place].astype(np.uint64)
    piece[start[1:] - 1] &= np.uint64(0xFFFFFFFFFFFFFFFF) >> (64 - (length - 8 * (size - 1)) * 8).astype(np.uint64)
    factor = np.multiply.accumulate(np.full(int(size.max()), FACTORS[0], np.uint64))
    mixed = piece * factor[place]
    mixed ^= mixed >> np.uint64(29)
    hashed = np.add.reduceat(mixed, start[:-1])
    hashed ^= hashed >> np.uint64(32)
    hashed *= np.uint64(FACTORS[1])
    return hashed, length, start, piece


class Words:
    """Words with numbers from 0, to be found in shards: by their hash first, then by all their bytes."""

    def __init__(self, words: Iterable[bytes]):
        words = list(words)
        hashed, length, start, piece = digests(b"\n".join(words), len(words))
        self.number = np.argsort(hashed, kind="stable").astype(np.int32)
        self.hash, self.length = hashed[self.number], length[self.number]
        self.piece, self.start = piece[ranges(start, self.number)], starts_of((self.length + 7) >> 3)
        same = np.flatnonzero(np.diff(self.hash, prepend=~self.hash[:1]))
        # Words of a hash, 1 unless words meet by chance.
        self.most = int(np.diff(same, append=len(words)).max(initial=0))

    @classmethod
    def again(cls, parts: dict) -> Words:
        """The words that ``vars`` gave ``parts`` of; a broadcast has these alone, as executors may not have this module."""
        words = cls.__new__(cls)
        vars(words).update(parts)
        return words

    def __len__(self) -> int:
        return len(self.number)

    def of(self, row: dict) -> np.ndarray:
        """The number of each word of a shard, -1 without one."""
        hashed, length, start, piece = digests(row["words"], len(row["sizes"]) // 4)
        number, low = np.full(len(hashed), -1, np.int32), np.searchsorted(self.hash, hashed)
        for more in range(self.most):
            here = np.flatnonzero(low + more < len(self))
            here = here[self.hash[low[here] + more] == hashed[here]]
            here = here[self.length[low[here] + more] == length[here]]
            there = low[here] + more
            owner = np.repeat(np.arange(len(here)), (length[here] + 7) >> 3)
            other = owner[piece[ranges(start, here)] != self.piece[ranges(self.start, there)]]
            whole = np.ones(len(here), bool)
            whole[other] = False
            number[here[whole]] = self.number[there[whole]]
        return number


def pieces(sizes: np.ndarray) -> Iterator[slice]:
    """Cuts lists of these sizes into pieces with about ``ENTRIES`` entries, a list at least."""
    ends = np.cumsum(sizes)
    low = 0
    while low < len(sizes):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + ENTRIES, "right")))
        yield slice(low, high)
        low = high


def index(docs: DataFrame) -> DataFrame:
    """Shards of ``docs(doc, text)``; texts without words are in them with length 0."""

    def shard(numbers: dict, known: dict, docs: list, text_of: list, flat: list, lengths: list) -> pa.RecordBatch:
        n, sizes = len(lengths), np.array(lengths, np.int64)
        flat = np.concatenate([np.zeros(0, np.int32), *flat])
        text = np.repeat(np.arange(n, dtype=np.int32), sizes)
        # Words come by their hash.
        names = list(numbers)
        by_hash = np.argsort(digests(b"\n".join(names), len(names))[0], kind="stable")
        renamed = np.empty(len(names), np.int32)
        renamed[by_hash] = np.arange(len(names), dtype=np.int32)
        flat, names = renamed[flat], [names[i] for i in by_hash]
        # Texts that have the same frequent words become neighbours.
        order, groups = alike(text, flat, n, GROUP_TEXTS, len(names))
        place = np.empty(n, np.int32)
        place[order] = np.arange(n, dtype=np.int32)
        # Each word with its texts, by word and place.
        key = flat.astype(np.int64)
        del flat
        key *= n
        key += place[text]
        del text
        key.sort()
        first = np.flatnonzero(np.diff(key, prepend=-1))
        times = smallest(np.diff(first, append=len(key)))
        key = key[first]
        in_list = np.bincount(key // max(1, n), minlength=len(numbers))
        texts = smallest(key % max(1, n))
        del key, first
        # Rows by place of their text and by id, NULL last.
        has_id = np.array([d is not None for d in docs], bool)
        ids, owner = np.array([d or 0 for d in docs], np.int64), place[np.array(text_of, np.int64)]
        by_text = np.lexsort((ids, ~has_id, owner))
        copies = np.bincount(owner, minlength=n)
        found = np.add.reduceat(copies[texts], starts_of(in_list)[:-1]) if len(numbers) else np.zeros(0, np.int64)
        values = {
            "doc_ids": ids[by_text], "has_id": has_id[by_text], "doc_start": starts_of(copies), "groups": groups,
            "lengths": sizes[order], "sizes": in_list.astype(np.uint32), "found": found.astype(np.uint32), "texts": texts, "times": times,
        }
        row = {name: [v.tobytes()] for name, v in values.items()}
        row |= {"words": [b"\n".join(names)], "n_texts": [len(docs)], "n_words": [int(copies @ sizes[order])]}
        kinds = {"n_texts": pa.int64(), "n_words": pa.int64()}
        columns = [c.split()[0] for c in INDEX.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(row[c], kinds.get(c, pa.binary())) for c in columns], columns)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def fresh():
            numbers: defaultdict = defaultdict()
            numbers.default_factory = numbers.__len__
            return numbers, {}, [], [], [], []

        held, state = 0, fresh()
        for batch in batches:
            for doc, text in zip(batch.column("doc").to_pylist(), utf8(batch.column("text"))):
                numbers, known, docs, text_of, flat, lengths = state
                digest = hashlib.blake2b(text, digest_size=16).digest()
                if digest not in known:
                    known[digest] = len(lengths)
                    words = words_of(text)
                    flat.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
                    lengths.append(len(words))
                    held += len(words)
                text_of.append(known[digest])
                docs.append(doc)
                held += 1
                if held >= SHARD_WORDS:
                    del flat, lengths, numbers
                    held, whole, state = 0, state, fresh()
                    yield shard(*whole)
                    del whole
        if held:
            yield shard(*state)

    return docs.mapInArrow(build, INDEX)


class Shard:
    """A shard's lists over the words of a block of queries alone."""

    def __init__(self, row: dict, wanted: Words, idf: np.ndarray, mean_length: float):
        part = lambda name, kind: np.frombuffer(row[name], kind)
        self.doc_ids, self.has_id = part("doc_ids", np.int64), part("has_id", bool)
        self.doc_start, lengths = part("doc_start", np.int64), part("lengths", np.int64)
        self.n = len(lengths)
        # Blocks that each group of texts starts with; a group's last block may have places without a text.
        groups = np.unique(part("groups", np.int64))
        self.cuts = starts_of(-(-np.diff(groups) // BLOCK_TEXTS))
        self.blocks = int(self.cuts[-1])
        self.width = self.blocks * BLOCK_TEXTS
        # Sums are laid out by place in a block and by block, so that their maxima take one pass.
        group = np.repeat(np.arange(len(groups) - 1), np.diff(groups))
        block, inside = np.divmod(np.arange(self.n) - groups[group], BLOCK_TEXTS)
        place = (inside * self.blocks + self.cuts[group] + block).astype(np.int32)
        self.text_at = np.zeros(self.width, np.int64)
        self.text_at[place] = np.arange(self.n)
        starts, number = starts_of(part("sizes", np.uint32)).astype(np.int32), wanted.of(row)
        lists = np.flatnonzero(number >= 0)
        lists = lists[np.argsort(number[lists])]
        words, at = number[lists], ranges(starts, lists)
        # The words that the shard has are numbered anew.
        self.words, self.local = words, np.full(len(idf), -1, np.int32)
        self.local[words] = np.arange(len(words))
        self.sizes = starts[lists + 1] - starts[lists]
        self.start = starts_of(self.sizes).astype(np.int32)
        texts, times = (np.frombuffer(row[c], KINDS[len(row[c]) // starts[-1]] if starts[-1] else np.uint8) for c in ("texts", "times"))
        text, value = texts[at].astype(np.int32), times[at].astype(float)
        del at, starts, number
        lengths = K1 * (1 - B + B * lengths / max(mean_length, 1e-9))
        below = lengths[text]
        below += value
        value *= K1 + 1
        value /= below
        value *= np.repeat(idf[words], self.sizes)
        del below
        # A list's entries: the place in the sums and, in the same eight bytes, the value.
        self.entry = np.empty((len(text), 2), np.int32)
        self.entry[:, 0] = place[text]
        self.entry[:, 1] = value.astype(np.float32).view(np.int32)
        self.entry = self.entry.ravel().view(np.int64)
        # Texts of the groups that have a word.
        word = np.repeat(np.arange(len(words), dtype=np.int32), self.sizes)
        self.has = np.zeros((len(self.cuts) - 1, len(words)), bool)
        self.has.ravel()[(group * len(words))[text] + word] = True
        self.spread = np.diff(self.cuts) * BLOCK_TEXTS @ self.has
        # By text, and in a text by word.
        order = text.astype(np.int64)
        order <<= 32
        order += np.arange(len(order), dtype=np.uint32)
        order.sort()
        order &= 0xFFFFFFFF
        self.text_start = starts_of(np.bincount(text, minlength=self.n)).astype(np.int32)
        self.by_text, self.word = value[order], word[order]

    def entries(self, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and values of the entries of ``lists``, one list after the other."""
        found = self.entry[ranges(self.start, lists)]
        return found.view(np.int32)[::2], found.view(np.float32)[1::2]

    def split(self, words: np.ndarray, queries: int) -> None:
        """Split off the words that many of the queries, whose words are ``words``, and many texts have.

        Counted are the texts of the groups that have a word, as the others' products leave it out.
        """
        asked = np.bincount(words, minlength=len(self.words))
        share = asked * self.sizes / (max(1, queries) * self.spread)
        words = np.flatnonzero(share > SPLIT_SHARE)
        words = words[np.argsort(-share[words], kind="stable")]
        words = words[np.cumsum(self.spread[words]) <= MATRIX]
        self.column = np.full(len(asked), -1, np.int32)
        self.column[words] = np.arange(len(words))
        # A group of texts has a matrix of its own, with the words that it has; here all of them stand in one array.
        has, high = self.has[:, words], np.diff(self.cuts)
        used = np.count_nonzero(has, axis=1)
        start = starts_of(used * high * BLOCK_TEXTS)
        values, own = np.zeros(start[-1], np.float32), np.cumsum(has, axis=1) - 1
        place, value = self.entries(words)
        column = np.repeat(np.arange(len(words)), self.sizes[words])
        row, block = np.divmod(place, self.blocks)
        group = np.repeat(np.arange(len(high)), high)[block]
        at = (row * high[group] + block - self.cuts[group]) * used[group]
        at += start[group]
        at += own[group, column]
        values[at] = value
        self.most, self.parts = np.zeros((self.blocks, len(words)), np.float32), []
        for i, (first, last) in enumerate(zip(self.cuts[:-1], self.cuts[1:])):
            columns = np.flatnonzero(has[i])
            matrix = values[start[i] : start[i + 1]].reshape(BLOCK_TEXTS, last - first, len(columns))
            self.most[first:last, columns] = matrix.max(axis=0)
            self.parts.append((first, last, columns, matrix))

    def full(self, query: np.ndarray, text: np.ndarray, first: np.ndarray, words: np.ndarray, member: np.ndarray) -> np.ndarray:
        """Whole scores of pairs of a query, in rising order, and a text.

        A query's words start at ``first``; ``member`` is room for the words of some queries, and comes back empty.
        """
        scores, kinds = np.zeros(len(text)), len(self.words)
        asking, row = np.unique(query, return_inverse=True)
        rows = max(1, len(member) // max(1, kinds))
        for low in range(0, len(asking), rows):
            some = asking[low : low + rows]
            own = words[ranges(first, some)].astype(np.int64)
            own += np.repeat(np.arange(len(some)) * kinds, first[some + 1] - first[some])
            member[own] = True
            pairs = slice(*np.searchsorted(row, [low, low + rows]))
            its, base, out = text[pairs], (row[pairs] - low) * kinds, scores[pairs]
            size = self.text_start[its + 1] - self.text_start[its]
            for part in pieces(size):
                at = ranges(self.text_start, its[part])
                place = np.repeat(base[part], size[part])
                place += self.word[at]
                has = np.flatnonzero(member[place])
                owner = np.repeat(np.arange(part.stop - part.start), size[part])
                out[part] = np.bincount(owner[has], self.by_text[at[has]], part.stop - part.start)
            member[own] = False
        return scores

    def sums(self, query: np.ndarray, words: np.ndarray, queries: int) -> np.ndarray:
        """By query and place, what the lists of ``words`` add."""
        out, size = np.zeros(queries * self.width, np.float32), self.sizes[words]
        base = (query * self.width).astype(np.int32 if out.size < 1 << 31 else np.int64)
        for part in pieces(size):
            place, value = self.entries(words[part])
            place = place + np.repeat(base[part], size[part])
            np.add.at(out, place, value)
        return out.reshape(queries, self.width)

    def reach(self, asked: np.ndarray, sums: np.ndarray, low: np.ndarray) -> np.ndarray:
        """By query and block of texts, whether a text can reach the query's score ``low``, by the maxima of the lists split off."""
        bound = asked.T @ self.most.T
        bound += sums.reshape(len(sums), BLOCK_TEXTS, self.blocks).max(axis=1)
        return (bound >= low[:, None]) & (bound > 0)

    def live(self, can: np.ndarray) -> np.ndarray:
        """Blocks of texts in which some query can reach its score."""
        return np.flatnonzero(can.any(axis=0))

    def passing(self, query: np.ndarray, words: np.ndarray, least: np.ndarray, k: int, member: np.ndarray):
        """Pairs of a query and a text that may be among the k best: their queries, texts and whole scores.

        ``query`` and ``words`` are the words, by the shard's numbers, of queries that are numbered from 0; ``least``
        is the score a text has to reach, per query.
        """
        queries, column = len(least), self.column[words]
        split = column >= 0
        # By word and query.
        asked = np.zeros((self.most.shape[1], queries), np.float32)
        asked[column[split], query[split]] = 1
        total = self.sums(query[~split], words[~split], queries)
        # All terms are positive, so sums in single precision are off by this share at most.
        longest = int(np.bincount(query, minlength=1).max()) + self.most.shape[1] + 8
        off = longest * 2.0**-22
        # The next smaller number in single precision.
        under = lambda scores: np.nextafter((scores * (1 - off) - SLACK).astype(np.float32), np.float32(-np.inf))
        low = under(least)
        can = self.reach(asked, total, low)
        live = self.live(can)
        if not len(live):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        # The places of other queries and blocks keep the sums of the rarer words, which don't pass.
        blocks = total.reshape(queries, BLOCK_TEXTS, self.blocks)
        for first, last, used, matrix in self.parts:
            here, asking = live[slice(*np.searchsorted(live, [first, last]))], np.flatnonzero(can[:, first:last].any(axis=1))
            if not len(asking) or not len(used):
                continue
            if len(here) < last - first:
                matrix = matrix[:, here - first]
            own = asked.take(used, axis=0)
            if len(asking) < queries:
                own = own.take(asking, axis=1)
            more = own.T @ matrix.reshape(-1, len(used)).T
            more = more.reshape(len(asking), BLOCK_TEXTS, len(here))
            if len(here) == last - first:
                blocks[asking, :, first:last] += more
            else:
                blocks[asking[:, None, None], np.arange(BLOCK_TEXTS)[:, None], here] += more
        low = np.maximum(low, np.float32(1e-30))
        may = total >= low[:, None]
        many = np.flatnonzero(np.count_nonzero(may, axis=1) > 2 * k)
        if len(many):
            low[many] = np.maximum(low[many], under(np.partition(total[many], -k, axis=1)[:, -k].astype(float)))
            may[many] &= total[many] >= low[many, None]
        asking, place = np.divmod(np.flatnonzero(may), self.width)
        text = self.text_at[place]
        return asking, text, self.full(asking, text, starts_of(np.bincount(query, minlength=queries)), words, member)


class Best:
    """The k best rows of each query so far."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.score, self.doc = np.full((queries, k), -1.0), np.zeros((queries, k), np.int64)
        self.has = np.zeros((queries, k), bool)

    def least(self, low: int, high: int) -> np.ndarray:
        """The score to reach; 0 or less for queries with less than k rows."""
        return self.score[low:high, -1].copy()

    def add(self, low: int, high: int, query: np.ndarray, score: np.ndarray, doc: np.ndarray, has: np.ndarray) -> None:
        """More rows for queries that are numbered from ``low``."""
        old, place = np.nonzero(self.score[low:high] >= 0)
        query = np.concatenate([old, query])
        score, doc, has = (
            np.concatenate([kept[low:high][old, place], more])
            for kept, more in ((self.score, score), (self.doc, doc), (self.has, has))
        )
        order = np.lexsort((doc, ~has, -score, query))
        query = query[order]
        rank = np.arange(len(order)) - np.searchsorted(query, query)
        order, query, rank = (a[rank < self.k] for a in (order, query, rank))
        for kept, more in ((self.score, score), (self.doc, doc), (self.has, has)):
            kept[low + query, rank] = more[order]


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(name)[i].as_buffer() for name in batch.schema.names}


def best_of(
    shards: Iterator[dict], wanted: Words | dict, start: np.ndarray, words: np.ndarray, idf: np.ndarray, mean: float, k: int,
    cuts: np.ndarray | None = None,
) -> Best:
    """The k best rows of all the shards for queries with these words (``start`` cuts them by query, ``cuts`` the queries by group)."""
    queries = len(start) - 1
    best, wanted = Best(queries, k), Words(wanted) if isinstance(wanted, dict) else wanted
    cuts = np.array([0, queries]) if cuts is None else cuts
    for row in shards:
        shard = Shard(row, wanted, idf, mean)
        if not len(shard.words):
            continue
        step, kinds = max(1, SUMS // shard.width), len(shard.words)
        member = np.zeros(max(1, MEMBERS // kinds) * kinds, bool)
        for first, last in zip(cuts[:-1], cuts[1:]):
            its = shard.local[words[start[first] : start[last]]]
            query = np.repeat(np.arange(last - first), np.diff(start[first : last + 1]))
            query, its = query[its >= 0], its[its >= 0]
            if not len(its):
                continue
            shard.split(its, last - first)
            for low in range(0, last - first, step):
                high = min(low + step, last - first)
                some = slice(*np.searchsorted(query, [low, high]))
                asking, text, score = shard.passing(query[some] - low, its[some], best.least(first + low, first + high), k, member)
                # Of equal texts, the k first rows.
                asking, text, score = asking[score > 0], text[score > 0], np.round(score[score > 0], DIGITS)
                copies = np.minimum(shard.doc_start[text + 1] - shard.doc_start[text], k)
                at = np.repeat(shard.doc_start[text] - np.cumsum(copies) + copies, copies) + np.arange(copies.sum())
                best.add(first + low, first + high, np.repeat(asking, copies), np.repeat(score, copies), shard.doc_ids[at], shard.has_id[at])
    return best


def query_blocks(texts: DataFrame) -> Iterator[tuple[list[str], list[np.ndarray], Words, np.ndarray]]:
    """(keys, word numbers of each, words, starts of groups) for blocks of ``texts(key, text)``.

    A block holds about ``QUERY_WORDS`` words, each text's distinct ones; no more than one block is on the
    driver. Queries that have the same frequent words are neighbours.
    """
    distinct = F.size(F.array_distinct(F.split(F.lower("text"), f"{BLANKS}+")))
    size, numbers = texts.agg(F.sum(F.octet_length("text")), F.sum(distinct)).first()
    count = max((size or 0) // QUERY_BYTES, (numbers or 0) // QUERY_WORDS) + 1
    for number in range(count):
        part = texts.filter(F.pmod(F.xxhash64("key"), F.lit(count)) == number).toArrow()
        wanted: dict[bytes, int] = {}
        keys, words = part["key"].to_pylist(), []
        for text in utf8(part["text"].combine_chunks()):
            distinct = dict.fromkeys(words_of(text))
            words.append(np.array([wanted.setdefault(w, len(wanted)) for w in distinct], np.int32))
        owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
        flat = np.concatenate([np.zeros(0, np.int32), *words])
        order, cuts = alike(owner, flat, len(words), GROUP_QUERIES, len(wanted))
        yield [keys[i] for i in order], [words[i] for i in order], Words(wanted), cuts


def search(
    docs: DataFrame, queries: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    query_id: str = "query_id", query_text: str = "query_text", k: int = TOP,
) -> DataFrame:
    """(query id, rank, id, score): the k best rows of ``docs`` for every row of ``queries``.

    A query is the set of its words, however often it has them. Rows without any of them are not
    returned, so a query without words has no result. Equal scores (to nine digits) rank by id,
    NULL last. Rows of ``docs`` that repeat rank one after the other. Queries of equal text are
    searched once; each of them gets the result, a query that repeats gets it once.
    """
    spark = docs.sparkSession
    plain = docs.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).alias("text"))
    asked = queries.select(
        F.col(query_id).cast("bigint").alias("query"), F.coalesce(query_text, F.lit("")).alias("text")
    ).withColumn("key", F.md5("text"))
    texts = materialize(asked.groupBy("key").agg(F.first("text").alias("text")), "search-texts")
    shards = materialize(index(plain), "search-index")
    n_texts, n_words = shards.agg(F.coalesce(F.sum("n_texts"), F.lit(0)), F.coalesce(F.sum("n_words"), F.lit(0))).first()
    mean_length, best = n_words / max(1, n_texts), None
    tasks = max(1, TASKS * spark.sparkContext.defaultParallelism)
    for keys, words, wanted, cuts in query_blocks(texts):
        numbers = spark.sparkContext.broadcast(vars(wanted))

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            # Summed over the shards of a task, so that it hands on a row a word, however many shards there are.
            known = Words.again(numbers.value)
            found = np.zeros(len(known), np.int64)
            for row in rows_of(batches):
                number = known.of(row)
                used = number >= 0
                found[number[used]] += np.frombuffer(row["found"], np.uint32)[used]
            word = np.flatnonzero(found)
            for low in range(0, len(word), ENTRIES):
                some = word[low : low + ENTRIES]
                yield pa.RecordBatch.from_pydict({"word": pa.array(some, pa.int64()), "n": pa.array(found[some], pa.int64())})

        lists = shards.select("words", "sizes", "found").coalesce(tasks)
        counted = lists.mapInArrow(count, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")).toArrow()
        n = np.zeros(len(wanted))
        n[counted["word"].to_numpy()] = counted["n"].to_numpy()
        idf = np.log(1 + (n_texts - n + 0.5) / (n + 0.5))
        start = starts_of(np.array([len(w) for w in words], np.int64))
        given = spark.sparkContext.broadcast((keys, start, np.concatenate([np.zeros(0, np.int32), *words]), idf, cuts))

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keys, start, words, idf, cuts = given.value
            # A worker still holds what the tasks before took.
            pa.default_memory_pool().release_unused()
            found = best_of(rows_of(batches), Words.again(numbers.value), start, words, idf, mean_length, k, cuts)
            query, place = np.nonzero(found.score >= 0)
            yield pa.RecordBatch.from_arrays([
                pa.array([keys[q] for q in query], pa.string()),
                pa.array(found.doc[query, place], mask=~found.has[query, place]), pa.array(found.score[query, place]),
            ], ["key", "doc", "score"])

        # A task goes through several shards, so that it hands on k rows a query, however many shards there are.
        met = shards.drop("found", "n_texts", "n_words").coalesce(tasks).mapInArrow(meet, "key string, doc bigint, score double")
        part = materialize(met, "search-met")
        numbers.unpersist()
        given.unpersist()
        best = part if best is None else best.unionByName(part)
    order = Window.partitionBy("key").orderBy(F.desc("score"), F.col("doc").isNull(), "doc")
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    found = asked.select("query", "key").distinct().join(materialize(ranked, "search-ranked"), "key")
    return found.select(F.col("query").alias(query_id), "rank", F.col("doc").alias(id_col), "score")
