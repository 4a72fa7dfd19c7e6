"""Language of a text as a mixture of languages.

Training counts hashed letter trigrams per language over all training texts. A text is taken
as drawn from a mixture: expectation-maximisation finds the share of each language, and languages
join the set, largest share first, while the gain in log-likelihood exceeds a penalty that grows
with the logarithm of the text's length. The largest share within the set names the language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanspark.llm.common import map_rows, shelters
from gleanspark.storage import materialize

BUCKETS = 1 << 16
SMOOTHING = 0.1
# Log-likelihood a further language has to gain, times the logarithm of the number of trigrams. A
# letter is part of three trigrams, hence 3 in place of 1.
PENALTY = 3.0
# Expectation-maximisation ends once at most so much log-likelihood is left to gain.
CONVERGED = 1e-2
# Languages counted at once in a task, which bounds its memory.
HELD_LANGUAGES = 64
UNKNOWN = "und"
MIN_SCORE = 0.5

TO_BLANK = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
MIX = np.uint32(0x9E3779B1)
CHUNK = 1 << 20


def has_letter(text: str) -> bool:
    """Whether a character of a letter category (L*) occurs; digits and number signs are none."""
    return next(filter(str.isalpha, text), None) is not None


def trigrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the letter trigrams of a text between blanks, and how often each occurs."""
    raw = b" %b " % (text or "").lower().encode("utf-8", "replace").translate(TO_BLANK)
    total = None
    for start in range(0, max(1, len(raw) - 2), CHUNK):
        b = np.frombuffer(raw[start : start + CHUNK + 2], dtype=np.uint8).astype(np.uint32)
        code = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
        code = code[code != 0x202020]
        bucket = (code * MIX) >> 16
        if len(bucket) < 4096 and len(raw) <= CHUNK:
            return np.unique(bucket, return_counts=True)
        counts = np.bincount(bucket, minlength=BUCKETS)
        total = counts if total is None else total + counts
    seen = np.flatnonzero(total)
    return seen, total[seen]


def counts_per_language(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """(lang, bucket, n) over all texts with a language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def handed_on():
            for lang, counts in held.items():
                seen = np.flatnonzero(counts)
                columns = [pa.array([lang] * len(seen), pa.string()), pa.array(seen), pa.array(counts[seen])]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "bucket", "n"])
            held.clear()

        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1)):
                lang = lang.as_py()
                if lang not in held:
                    if len(held) == HELD_LANGUAGES:
                        yield from handed_on()
                    held[lang] = np.zeros(BUCKETS, dtype=np.int64)
                bucket, n = trigrams(text.as_py())
                held[lang][bucket] += n
        yield from handed_on()

    known = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    counted = known.filter("lang IS NOT NULL").mapInArrow(count, "lang string, bucket bigint, n bigint")
    return counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class Mixture:
    """Trigram probabilities of each language: a row per bucket, a column per language."""

    def __init__(self, names: list[str], table: np.ndarray, penalty: float = PENALTY):
        self.names, self.table, self.penalty = names, table, penalty

    @staticmethod
    def fitted(docs: DataFrame, text_col: str, lang_col: str) -> "Mixture":
        """From all texts with a language. A language at a time comes to the driver, one number
        per bucket."""
        counts = materialize(counts_per_language(docs, text_col, lang_col), "language-counts")
        langs = docs.select(F.col(lang_col).cast("string").alias("lang")).filter("lang IS NOT NULL")
        names = sorted(r[0] for r in langs.distinct().collect())
        table = np.zeros((BUCKETS, len(names)), dtype=np.float32)
        for place, name in enumerate(names):
            found = counts.filter(F.col("lang") == name).select("bucket", "n").toArrow()
            n = np.zeros(BUCKETS)
            n[found["bucket"].to_numpy()] = found["n"].to_numpy()
            table[:, place] = (n + SMOOTHING) / (n.sum() + SMOOTHING * BUCKETS)
        return Mixture(names, table / table.max(axis=1, keepdims=True) if names else table)

    @staticmethod
    def shares(likely: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Shares of the mixture by expectation-maximisation, run until it has converged."""
        likely, weight = likely.astype(np.float64), weight.astype(np.float64)
        total, share = weight.sum(), np.full(likely.shape[1], 1 / likely.shape[1])
        while True:
            grown = (weight / (likely @ share)) @ likely / total
            share = share * grown
            # No mixture is likelier than this one by more than the logarithm of the largest factor.
            if total * np.log(grown.max()) < CONVERGED:
                return share

    def judge(self, text: str | None) -> tuple[str, float, bool]:
        """The language, the share of it in the mixture of all languages, and whether the text is
        long enough for a second language to exceed the penalty."""
        if not self.names or not text or not has_letter(text):
            return UNKNOWN, 0.0, False
        bucket, n = trigrams(text)
        likely, weight = self.table[bucket], n.astype(np.float32)
        overall = self.shares(likely, weight)
        order = np.argsort(-overall, kind="stable")
        chosen, share = order[:1], np.ones(1)
        best = weight @ np.log(likely[:, order[0]])
        needed = self.penalty * np.log(weight.sum() + 1)
        # No mixture is likelier than the likeliest language of every trigram.
        long_enough = weight @ np.log(likely.max(axis=1)) - best > needed
        for size in range(2, len(order) + 1 if long_enough else 2):
            part = likely[:, order[:size]]
            tried = self.shares(part, weight)
            reached = weight @ np.log(part @ tried)
            if reached - best <= needed:
                break
            chosen, share, best = order[:size], tried, reached
        name = chosen[int(np.argmax(share))]
        return self.names[name], float(min(1.0, max(0.0, overall[name]))), bool(long_enough)


def with_language(
    docs: DataFrame, training: DataFrame, text_col: str = "text", lang_col: str = "lang",
    names: tuple[str, ...] = ("lang_pred", "score"),
) -> DataFrame:
    """``docs`` with the language and its share, learned from ``training`` alone.

    A text that is NULL, empty or without a letter is ``und`` with score 0, as is every text when
    nothing was learned; any other text, however short, gets a language. Equal shares go to the first
    language by code point. A third name adds whether a second language could be told in the text.
    """
    model = Mixture.fitted(training, text_col, lang_col)
    shared = docs.sparkSession.sparkContext.broadcast((model.names, model.table))

    def work():
        judge = Mixture(*shared.value).judge

        def step(batch: pa.RecordBatch) -> dict:
            found = [judge(t.as_py()) for t in batch.column(text_col)]
            return dict(zip(names, zip(*found) if found else [[]] * len(names)))

        return step

    kinds = zip(names, ("string", "double", "boolean"))
    return map_rows(docs, work, ", ".join(f"{name} {kind}" for name, kind in kinds))


@shelters
def identified(docs: DataFrame, training: DataFrame, text_col: str = "text", lang_col: str = "lang",
               min_score: float = MIN_SCORE) -> DataFrame:
    """The rows of ``docs`` whose language is found with a share of at least ``min_score``; of texts
    too short to tell a second language in, all that have a language."""
    own = ("__lang", "__share", "__long")
    found = with_language(docs, training, text_col, lang_col, own)
    known: Column = (F.col(own[0]) != UNKNOWN) & ((F.col(own[1]) >= min_score) | ~F.col(own[2]))
    return found.filter(known).drop(*own)
