"""Text embeddings: hashed word counts, or a model the caller brings."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Hex digits of a word's hash that choose its bucket: enough for any sensible dimension.
WORD_DIGITS = 7


def word_buckets(words: pa.Array, dim: int) -> np.ndarray:
    """The bucket of each word: its hash modulo ``dim``. A word that comes often is hashed once."""
    coded = words.cast(pa.large_binary()).dictionary_encode()
    digests = b"".join(md5(w.as_py(), usedforsecurity=False).digest()[:4] for w in coded.dictionary)
    bits = np.frombuffer(digests, dtype=">u4") >> (4 * (8 - WORD_DIGITS))
    return (bits.astype(np.int64) % dim)[coded.indices.to_numpy()]


def hashed_vector(tokens: Column, dim: int) -> Column:
    """Word counts per hash bucket as ``array<double>``."""

    @F.arrow_udf("array<double>")
    def count_buckets(tokens: pa.Array) -> pa.Array:
        rows = len(tokens)
        sizes = np.diff(tokens.offsets.to_numpy())
        places = np.repeat(np.arange(rows) * dim, sizes) + word_buckets(tokens.flatten(), dim)
        counts = np.bincount(places, minlength=rows * dim).astype("float64")
        offsets = np.arange(0, rows * dim + 1, dim, dtype="int32")
        return pa.ListArray.from_arrays(offsets, counts)

    return count_buckets(tokens)


def embed_with(
    df: DataFrame,
    text_col: str,
    load: Callable[[], Callable[[pd.Series], list]],
    out: str = "embedding",
) -> DataFrame:
    """Embed by a caller's model: ``load()`` runs once per task, its result per batch."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = load()
        for texts in batches:
            yield pd.Series([np.asarray(v, dtype="float64") for v in encode(texts)])

    return df.withColumn(out, run(F.col(text_col)))
