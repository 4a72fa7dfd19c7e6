"""Quality of a text by boosted trees over its statistics.

The statistics of every whole text are computed in the tasks that read it. Trees are fitted on a
bounded sample of the labelled rows with histograms of binned values, and laid out as flat arrays
that a batch of texts walks level by level.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanspark.llm.common import map_rows, utf8
from gleanspark.storage import materialize

# Labelled rows the trees are fitted on, about this many at most, chosen by a hash of the id.
FIT_ROWS = 50_000
BINS = 64
TREES = 60
DEPTH = 4
RATE = 0.2
LEAF_WEIGHT = 1.0

STATISTICS = (
    "log_bytes", "log_words", "word_length", "upper", "lower", "digits", "symbols", "blanks",
    "non_ascii", "words_per_line", "distinct_words", "top_word", "ends_in_symbol", "upper_words",
    "repeated_lines", "repeated_pairs", "longest_word", "sentence_ends", "bars", "entropy",
)
CLASSES = np.zeros((256, 6))
for place, letters in enumerate((
    range(65, 91), range(97, 123), range(48, 58),
    [b for b in range(33, 127) if not chr(b).isalnum()], (9, 10, 11, 12, 13, 32), range(128, 256),
)):
    CLASSES[list(letters), place] = 1
WORD_SIGNS = frozenset(b"!\"#$%&'()*+/:;<=>?@[]^_`{|}~\\")
SENTENCE_ENDS = frozenset(b".?!")


def statistics(text: bytes) -> list[float]:
    """Values of ``STATISTICS``; shares of an empty text are 0."""
    if not text:
        return [0.0] * len(STATISTICS)
    counts = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    share = counts / len(text)
    upper, lower, digits, symbols, blanks, other = share @ CLASSES
    seen = share[share > 0]
    words, lines = text.split(), text.splitlines()
    n = max(1, len(words))
    tally = Counter(words)
    pairs = len(set(zip(words, words[1:]))) if n > 1 else 0
    last = Counter(w[-1] for w in words)
    return [
        float(np.log1p(len(text))), float(np.log1p(len(words))), sum(map(len, words)) / n,
        upper, lower, digits, symbols, blanks, other,
        n / max(1, len(lines)), len(tally) / n, max(tally.values(), default=0) / n,
        sum(c for b, c in last.items() if b in WORD_SIGNS) / n,
        sum(map(bytes.isupper, words)) / n,
        1 - len(set(lines)) / max(1, len(lines)), 1 - pairs / max(1, len(words) - 1) if n > 1 else 0.0,
        max(map(len, words), default=0), sum(c for b, c in last.items() if b in SENTENCE_ENDS) / n,
        float(share[124]), float(-(seen * np.log2(seen)).sum()),
    ]


def with_statistics(docs: DataFrame, text_col: str, name: str) -> DataFrame:
    def work():
        def step(batch: pa.RecordBatch) -> dict:
            return {name: [statistics(t) for t in utf8(batch.column(text_col))]}

        return step

    return map_rows(docs, work, f"{name} array<float>", [c for c in docs.columns if c != text_col])


@dataclass
class BoostedTrees:
    """Trees of one depth as arrays: node i of a tree goes on to 2 i + 1 and 2 i + 2."""

    edges: np.ndarray
    base: float
    feature: np.ndarray
    edge: np.ndarray
    leaf: np.ndarray

    @staticmethod
    def fitted(x: np.ndarray, label: np.ndarray) -> BoostedTrees:
        edges = np.zeros((x.shape[1], BINS - 1), dtype=np.float32)
        if len(x):
            edges = np.quantile(x, np.arange(1, BINS) / BINS, axis=0).T.astype(np.float32)
        bins = binned(x, edges)
        positive = float(label.sum())
        base = float(np.log((positive + 0.5) / (len(label) - positive + 0.5)))
        inner, leaves = (1 << DEPTH) - 1, 1 << DEPTH
        trees = BoostedTrees(
            edges, base, np.zeros((TREES, inner), np.int32), np.full((TREES, inner), BINS, np.int32),
            np.zeros((TREES, leaves)),
        )
        if not len(x) or positive in (0, len(label)):
            return trees
        score = np.full(len(x), base)
        for t in range(TREES):
            p = 1 / (1 + np.exp(-score))
            trees._grow(t, bins, label - p, p * (1 - p))
            score += trees.leaf[t, trees._reached(bins, t)]
        return trees

    def _grow(self, t: int, bins: np.ndarray, slope: np.ndarray, bend: np.ndarray) -> None:
        at = np.zeros(len(bins), dtype=np.int64)
        for level in range(DEPTH):
            first, nodes = (1 << level) - 1, 1 << level
            best = np.full(nodes, 1e-6)
            total = np.bincount(at, slope, nodes), np.bincount(at, bend, nodes)
            for f in range(bins.shape[1]):
                key = at * BINS + bins[:, f]
                g = np.bincount(key, slope, nodes * BINS).reshape(nodes, BINS).cumsum(axis=1)
                h = np.bincount(key, bend, nodes * BINS).reshape(nodes, BINS).cumsum(axis=1)
                rest_g, rest_h = total[0][:, None] - g, total[1][:, None] - h
                gain = (
                    g**2 / (h + LEAF_WEIGHT) + rest_g**2 / (rest_h + LEAF_WEIGHT)
                    - (total[0] ** 2 / (total[1] + LEAF_WEIGHT))[:, None]
                )[:, :-1]
                edge = gain.argmax(axis=1)
                better = gain[np.arange(nodes), edge] > best
                best[better] = gain[np.arange(nodes), edge][better]
                self.feature[t, first : first + nodes][better] = f
                self.edge[t, first : first + nodes][better] = edge[better]
            at = 2 * at + (bins[np.arange(len(bins)), self.feature[t, first + at]] > self.edge[t, first + at])
        g, h = np.bincount(at, slope, 1 << DEPTH), np.bincount(at, bend, 1 << DEPTH)
        self.leaf[t] = RATE * g / (h + LEAF_WEIGHT)

    def _reached(self, bins: np.ndarray, trees) -> np.ndarray:
        """Leaf each row ends at, for one tree or along a last axis of trees."""
        feature, edge = self.feature[trees], self.edge[trees]
        node = np.zeros((len(bins), *feature.shape[:-1]), dtype=np.int64)
        rows = np.arange(len(bins)).reshape(-1, *[1] * (feature.ndim - 1))
        every = np.arange(len(feature)) if feature.ndim > 1 else ()
        for _ in range(DEPTH):
            f, e = (feature[every, node], edge[every, node]) if feature.ndim > 1 else (feature[node], edge[node])
            node = 2 * node + 1 + (bins[rows, f] > e)
        return node - ((1 << DEPTH) - 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1."""
        reached = self._reached(binned(x, self.edges), slice(None))
        total = self.base + self.leaf[np.arange(TREES), reached].sum(axis=1)
        return 1 / (1 + np.exp(-total))


def binned(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Number of edges that each value is above."""
    columns = [np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)]
    return np.stack(columns, axis=1) if len(x) else np.zeros((0, len(edges)), dtype=np.int64)


def matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), len(STATISTICS))


def quality(
    docs: DataFrame, labels: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "quality", fit_rows: int = FIT_ROWS,
) -> DataFrame:
    """(id, held_out, score, predicted) of every row of ``docs``.

    The trees see labels of rows that are not ``held_out`` (a condition on ``doc``, the id). NULL
    and empty texts have statistics of 0 and are scored like any other; without labels every
    score is one half. Rows that repeat count as often as they occur.
    """
    plain = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    rows = materialize(with_statistics(plain, "text", "x"), "quality-statistics")
    known = labels.select(F.col(id_col).alias("doc"), F.col(label_col).cast("double").alias("label"))
    known = known.filter(~held_out & F.col("label").isNotNull())
    share = min(1.0, fit_rows / max(1, known.count()))
    drawn = F.pmod(F.xxhash64("doc"), F.lit(1 << 20)) < int(share * (1 << 20))
    sample = rows.join(known.filter(drawn), "doc").select("doc", "x", "label").toArrow()
    order = np.argsort(sample["doc"].to_numpy(), kind="stable")
    trees = BoostedTrees.fitted(matrix(sample["x"])[order], sample["label"].to_numpy()[order])
    # Broadcasts carry plain arrays, which need no code of this package to unpack.
    shared = docs.sparkSession.sparkContext.broadcast(vars(trees))

    def work():
        model = BoostedTrees(**shared.value)

        def step(batch: pa.RecordBatch) -> dict:
            return {"score": model.score(matrix(batch.column("x")))}

        return step

    scored = map_rows(rows, work, "score double", ["doc"])
    return scored.select(
        F.col("doc").alias(id_col), held_out.alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
