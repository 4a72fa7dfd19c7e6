import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gleanspark.operators import novelty as module
from gleanspark.operators.embedding import embed_with, hashed_vector
from gleanspark.operators.novelty import novelty

SCHEMA = "id bigint, v array<double>"
BLOCKS = {"broadcast_bytes": 0, "index": "blocks"}


def score(spark, cands, reals, **options):
    left = spark.createDataFrame(list(enumerate(cands)), SCHEMA)
    right = spark.createDataFrame(list(enumerate(reals)), SCHEMA)
    rows = novelty(left, right, "id", "v", with_id=True, **options).orderBy("id").collect()
    return [r["novelty"] for r in rows], [r["nearest_id"] for r in rows]


@pytest.mark.parametrize(
    "cand, real, expected",
    [
        ([1, 0], [1, 0], 2.0e-09),
        ([1, 0], [0, 1], 1),
        ([1, 0], [-1, 0], 1),
        ([0, 0], [1, 0], 1),
        ([3, 4], [4, 3], 0.0400000004),
    ],
)
@pytest.mark.parametrize("options", [{}, {"broadcast_bytes": 0}, BLOCKS])
def test_fixed_values(spark, cand, real, expected, options):
    [found], _ = score(spark, [[float(x) for x in cand]], [[float(x) for x in real]], **options)
    assert found == pytest.approx(expected, abs=1e-9)


def brute_force(cands, reals):
    unit = lambda m: m / (np.linalg.norm(m, axis=1, keepdims=True) + 1e-9)
    return np.clip(1 - (unit(cands) @ unit(reals).T).max(axis=1), 0, 1)


SMALL = {"broadcast_bytes": 0, "block_bytes": 8 * 8 * 20}


@pytest.mark.parametrize("options", [{}, SMALL, SMALL | BLOCKS, SMALL | {"cells": 1}, SMALL | {"cells": 70}])
def test_equals_brute_force_in_blocks_and_tiles(spark, monkeypatch, options):
    monkeypatch.setattr(module, "TILE_ROWS", 16)
    rng = np.random.default_rng(7)
    cands, reals = rng.normal(size=(90, 8)), rng.normal(size=(70, 8))
    # A third of both sides are copies of one row.
    cands[:30] = reals[:23].repeat(2, axis=0)[:30] = reals[5]
    reals[:23] = reals[5]
    found, nearest = score(spark, cands.tolist(), reals.tolist(), **options)
    assert found == pytest.approx(brute_force(cands, reals).tolist(), abs=1e-12)
    assert all(0 <= x <= 1 for x in found)
    assert set(nearest[:30]) == {0}


def test_repeated_and_missing_ids_keep_their_rows(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (None, [1.0, 1.0]), (None, [1.0, 1.0])]
    reals = spark.createDataFrame([(7, [2.0, 0.0]), (3, [1.0, 0.0]), (None, [1.0, 0.0])], SCHEMA)
    ways = [
        novelty(spark.createDataFrame(rows, SCHEMA), reals, "id", "v", with_id=True, **options)
        for options in ({}, BLOCKS | {"block_bytes": 16}, {"broadcast_bytes": 0, "block_bytes": 16})
    ]
    broadcast, blocks, pivots = [
        sorted((str(r["id"]), round(r["novelty"], 8), r["nearest_id"]) for r in way.collect()) for way in ways
    ]
    assert broadcast == blocks == pivots
    assert broadcast == [("1", 0.0, 3), ("1", 1.0, 3), ("None", 0.29289322, 3), ("None", 0.29289322, 3)]


def test_ties_are_measured_from_the_largest_similarity(spark):
    angle = lambda sim: [float(sim), float(np.sqrt(1 - sim * sim))]
    reals = [angle(0.9 - 1.6e-9), angle(0.9 - 0.8e-9), angle(0.9)]
    for options in ({}, BLOCKS | {"block_bytes": 16}, {"broadcast_bytes": 0, "block_bytes": 16}):
        assert score(spark, [[1.0, 0.0]], reals, **options)[1] == [1]


def test_tiles_on_both_sides_bound_the_memory():
    rng = np.random.default_rng(3)
    queries, trusted = rng.normal(size=(16384, 64)), rng.normal(size=(4096, 64))
    tracemalloc.start()
    module.first_reaching(queries, trusted, module.largest(queries, trusted))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3 * module.TILE_ROWS**2 * 8


def test_no_trusted_rows(spark):
    with pytest.raises(ValueError, match="at least one trusted row"):
        score(spark, [[1.0]], [])


def test_no_candidates(spark):
    assert score(spark, [], [[1.0, 2.0]]) == ([], [])
    assert score(spark, [], [[1.0, 2.0]], broadcast_bytes=0) == ([], [])
    assert score(spark, [], [[1.0, 2.0]], **BLOCKS) == ([], [])


def test_uneven_vectors_fail(spark):
    with pytest.raises(Exception, match="same length"):
        score(spark, [[1.0, 2.0], [1.0]], [[1.0, 2.0]])


def clustered(rng, rows, centres, spread):
    return centres[rng.integers(0, len(centres), rows)] + spread * rng.normal(size=(rows, centres.shape[1]))


def nearest_ids(cands, reals):
    """Smallest id within a tie of the largest similarity."""
    unit = lambda m: m / (np.linalg.norm(m, axis=1, keepdims=True) + 1e-9)
    similar = unit(cands) @ unit(reals).T
    return (similar >= similar.max(axis=1, keepdims=True) - module.TIE).argmax(axis=1).tolist()


def test_pivots_leave_most_pairs_out(spark):
    """On clustered vectors; a third of the candidates are one vector, and its cell is visited in blocks."""
    rng = np.random.default_rng(17)
    centres = rng.normal(size=(30, 16))
    cands, reals = clustered(rng, 900, centres, 0.1), clustered(rng, 1200, centres, 0.1)
    cands[:300] = cands[0]
    known = module.TrustedSet(
        spark.createDataFrame(list(enumerate(reals.tolist())), SCHEMA), "id", "v", broadcast_bytes=0,
        block_bytes=8 * 16 * 50,
    )
    found = known.score(spark.createDataFrame(list(enumerate(cands.tolist())), SCHEMA), "v", with_id=True)
    rows = found.orderBy("id").collect()
    assert [r["novelty"] for r in rows] == pytest.approx(brute_force(cands, reals).tolist(), abs=1e-12)
    assert [r["nearest_id"] for r in rows] == nearest_ids(cands, reals)
    assert 0 < known.pivots.pairs < 0.3 * len(cands) * len(reals)


def test_pivots_with_zero_short_and_opposite_vectors(spark):
    """Zero vectors have a cell of their own; vectors near the epsilon keep their shrunken length."""
    rng = np.random.default_rng(19)
    reals = np.concatenate([rng.normal(size=(40, 3)), 1e-9 * rng.normal(size=(20, 3)), np.zeros((2, 3))])
    cands = np.concatenate([rng.normal(size=(40, 3)), -reals[:10], 1e-9 * rng.normal(size=(9, 3)), np.zeros((2, 3))])
    for some in (reals, reals[40:], -np.abs(reals[:40])):
        options = {"broadcast_bytes": 0, "block_bytes": 8 * 3 * 7}
        found, nearest = score(spark, np.abs(cands).tolist(), some.tolist(), **options)
        assert found == pytest.approx(brute_force(np.abs(cands), some).tolist(), abs=1e-12)
        assert nearest == nearest_ids(np.abs(cands), some)


def test_unknown_index(spark):
    with pytest.raises(ValueError, match="unknown index"):
        score(spark, [[1.0]], [[1.0]], index="tree")


def test_hashed_vector_counts_every_word(spark):
    rows = [(0, ["a", "b", "a"]), (1, []), (2, ["c"] * 128)]
    df = spark.createDataFrame(rows, "id int, tokens array<string>").repartition(1)
    found = df.select("id", hashed_vector(F.col("tokens"), 16).alias("v")).orderBy("id").collect()
    assert [sum(r["v"]) for r in found] == [3, 0, 128]
    assert all(len(r["v"]) == 16 for r in found)
    assert max(found[2]["v"]) == 128


def test_own_model_is_loaded_once_per_task(spark):
    def load():
        loaded = []

        def encode(texts: pd.Series):
            loaded.append(1)
            return [[float(len(t)), float(len(loaded))] for t in texts]

        return encode

    rows = embed_with(spark.createDataFrame([("ab",), ("c",)], "text string").repartition(1), "text", load)
    assert sorted(r["embedding"][0] for r in rows.collect()) == [1.0, 2.0]


def test_a_word_is_hashed_once_in_a_batch(monkeypatch):
    import pyarrow as pa

    from gleanspark.operators import embedding

    hashed, real = [], embedding.md5

    def counted(word, **options):
        hashed.append(word)
        return real(word, **options)

    monkeypatch.setattr(embedding, "md5", counted)
    found = embedding.word_buckets(pa.array(["one", "two", "one"] * 500), 16)
    expected = {w: int(real(w.encode()).hexdigest()[:7], 16) % 16 for w in ("one", "two")}
    assert list(found) == [expected[w] for w in ("one", "two", "one")] * 500
    assert len(hashed) == 2
