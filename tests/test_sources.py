import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gleanspark.sources import pools, results
from gleanspark.sources.labelled import read_labelled, union_all, union_keyed, unique
from gleanspark.sources.templates import generated_in_waves, generated_pool, template_pool

ROWS = [(0, 'He said "no"\nand left', 0), (1, "Éçole", 1), (2, "Éçole", 1)]


@pytest.fixture
def pool(spark):
    return spark.createDataFrame(ROWS, pools.POOL_SCHEMA)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("pool_format", ["json", "parquet"])
def test_pool_round_trip(spark, pool, tmp_path, pool_format):
    pools.write_pool(pool, str(tmp_path / "p"), pool_format)
    assert rows(pools.read_pool(spark, str(tmp_path / "p"), pool_format)) == ROWS


def test_pool_array(spark, tmp_path):
    path = tmp_path / "pool.json"
    path.write_text(json.dumps([{"text": t, "label": l} for _, t, l in ROWS], indent=2), encoding="utf-8")
    assert rows(pools.read_pool_array(spark, str(path), with_ids=False)) == sorted(r[1:] for r in ROWS)


def awkward(n):
    """Texts with the signs an array is cut at, quoted and escaped, and some longer than a range."""
    signs = ['}', '{"a": [', '\\', '\\"', '"}, {"', ']', 'é}ö', '\n}\n', 'plain words']
    return [{"cand_id": i, "text": (signs[i % 9] + signs[i * 7 % 9]) * (1 + 40 * (i % 11 == 0)), "label": i % 3} for i in range(n)]


@pytest.fixture
def small_ranges(spark):
    conf = {"spark.sql.files.maxPartitionBytes": "64b", "spark.sql.files.openCostInBytes": "1b"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("layout", [{"indent": 2}, {}, {"ensure_ascii": False, "separators": (",", ":")}])
def test_an_array_is_read_by_ranges(spark, tmp_path, small_ranges, layout):
    elements = awkward(60)
    path = tmp_path / "pools"
    path.mkdir()
    for name, part in (("a", elements[:35]), ("b", elements[35:]), ("none", [])):
        (path / f"{name}.json").write_text(json.dumps(part, **layout), encoding="utf-8")
    from gleanspark.sources import arrays

    assert arrays.fragments(spark, str(path)).select("file", "start").distinct().count() > 20
    assert rows(pools.read_pool_array(spark, str(path))) == [tuple(e.values()) for e in elements]


def test_nested_and_missing_fields(spark, tmp_path, small_ranges):
    elements = [{"a": {"b": [{"c": "}" * i}, {"c": "]"}]}, "more": [[i]]} if i % 2 else {} for i in range(20)]
    (tmp_path / "n.json").write_text(json.dumps(elements))
    from gleanspark.sources.arrays import read_array

    found = read_array(spark, str(tmp_path / "n.json"), "a struct<b: array<struct<c: string>>>")
    texts = [None if r["a"] is None else [b["c"] for b in r["a"]["b"]] for r in found.collect()]
    assert sorted(texts, key=str) == sorted([["}" * i, "]"] if i % 2 else None for i in range(20)], key=str)


@pytest.mark.parametrize("broken", [
    '[{"cand_id": 1, "text": "a", "label": 0}', '[{"cand_id": 1, "text": "a}', '{"cand_id": 1}', '[{"cand_id": 1} {"cand_id": 2}]',
    '[{"cand_id": 1}] more', '[1, 2]', '[{"cand_id": 1}, 5]', '[{"cand_id": 1}, {"cand_id": ]', '[{"cand_id": "x"}]', '[{"cand_id": 1},]',
])
@pytest.mark.parametrize("ranges", ["64b", "7b"])
def test_broken_arrays_are_refused(spark, tmp_path, small_ranges, broken, ranges):
    spark.conf.set("spark.sql.files.maxPartitionBytes", ranges)
    (tmp_path / "broken.json").write_text(broken)
    with pytest.raises(Exception, match="inside its array|not an array of objects|MALFORMED_RECORD|CANNOT_PARSE"):
        pools.read_pool_array(spark, str(tmp_path / "broken.json")).collect()


@pytest.mark.parametrize("parts", [1, 3])
def test_array_round_trip(spark, pool, tmp_path, parts):
    pools.write_pool_array(pool.repartition(parts), str(tmp_path / "p"))
    assert rows(pools.read_pool_array(spark, str(tmp_path / "p"))) == ROWS
    for path in (tmp_path / "p").glob("part*"):
        assert isinstance(json.loads(path.read_text(encoding="utf-8")), list)


def test_unknown_pool_format(pool):
    with pytest.raises(ValueError, match="unknown pool format"):
        pools.write_pool(pool, "/nowhere", "csv")


def test_pool_is_built_once_and_guarded(spark, pool, tmp_path):
    path, calls = str(tmp_path / "p"), []
    build = lambda: calls.append(1) or pool
    for _ in range(2):
        assert rows(pools.pool_once(spark, path, 3, 42, build)) == ROWS
    assert calls == [1]
    with pytest.raises(ValueError, match="size 3, seed 42"):
        pools.pool_once(spark, path, 4, 42, build)


def test_a_foreign_pool_is_taken_as_it_is(spark, pool, tmp_path):
    path = str(tmp_path / "p")
    pool.write.parquet(path)
    assert rows(pools.pool_once(spark, path, 99, 1, lambda: pytest.fail("built"))) == ROWS


@pytest.mark.parametrize("source_format", ["parquet", "json", "orc"])
def test_labelled_tables_in_any_format(spark, tmp_path, source_format):
    df = spark.createDataFrame([(1, "a", 0, "x"), (2, "b", 1, "y")], "n bigint, body string, y int, more string")
    df.write.format(source_format).save(str(tmp_path / "t"))
    found = read_labelled(spark, str(tmp_path / "t"), "n", "body", "y", source_format)
    assert found.columns == ["id", "text", "label"] and rows(found) == [(1, "a", 0), (2, "b", 1)]


def test_unions_keep_copies_and_skip_missing_parts(pool):
    assert union_all(pool, None, pool).count() == 6
    with pytest.raises(ValueError):
        union_all(None)


def test_templates(spark):
    made = template_pool(spark.range(3000), "id", 2, 42)
    assert made.filter("text RLIKE '[{}]'").count() == 0
    assert made.filter("label <> cand_id % 2").count() == 0
    distinct = {r["label"]: r["n"] for r in
                made.groupBy("label").agg(F.countDistinct("text").alias("n")).collect()}
    assert all(200 < n <= 272 for n in distinct.values())
    happy = made.filter("label = 1 AND text RLIKE 'terrible|dreadful|boring|disappointing|forgettable'")
    assert happy.count() == 0
    again = template_pool(spark.range(3000).repartition(5), "id", 2, 42)
    assert made.exceptAll(again).count() == 0


def test_labels_other_than_one_take_the_negative_side(spark):
    made = template_pool(spark.range(300), "id", 3, 42)
    assert made.filter("label = 2 AND text RLIKE 'loved|adored|enjoyed|appreciated'").count() == 0


def test_own_generator(spark):
    made = generated_pool(spark.range(10), "id", 2, lambda batch: "t" + batch["label"].astype(str))
    assert rows(made) == [(i, f"t{i % 2}", i % 2) for i in range(10)]


def test_a_stopped_generator_is_not_asked_again(spark, tmp_path):
    """The second of three waves dies half way; its calls alone are made again."""
    calls, healed = str(tmp_path / "calls"), tmp_path / "healed"

    def generate(batch):
        import os

        for i in batch["cand_id"]:
            if i == victim and not os.path.exists(str(healed)):
                raise RuntimeError("stopped half way")
            with open(calls, "a") as log:
                log.write(f"{i}\n")
        return "t" + batch["label"].astype(str)

    folder = str(tmp_path / "waves")
    ids = spark.range(300)
    wave = lambda i: ids.filter(f"id = {i}").select(F.floor(F.pmod(F.xxhash64("id"), F.lit(12)) / 4)).first()[0]
    victim = next(i for i in range(100, 300) if wave(i) == 1)
    make = lambda chunks=12: generated_in_waves(ids, "id", 2, generate, folder, chunks, 4)
    with pytest.raises(Exception, match="stopped half way"):
        make()
    before = [int(i) for i in open(calls).read().split()]
    healed.write_text("")
    assert rows(make()) == [(i, f"t{i % 2}", i % 2) for i in range(300)]
    seen = Counter(int(i) for i in open(calls).read().split())
    waves = {r["id"]: r["wave"] for r in spark.read.parquet(f"{folder}/asked").collect()}
    assert set(seen) == set(range(300)) and any(waves[i] == 0 for i in before) and all(waves[i] < 2 for i in before)
    assert all(seen[i] == 1 for i in seen if waves[i] != 1) and all(seen[i] <= 2 for i in seen)
    assert rows(make()) == [(i, f"t{i % 2}", i % 2) for i in range(300)]
    assert Counter(int(i) for i in open(calls).read().split()) == seen
    with pytest.raises(ValueError, match="begun with 12 chunks"):
        make(6)


def test_the_note_is_there_before_the_pool(spark, pool, tmp_path):
    """A call that dies while it writes leaves no pool that could be taken for a foreign one."""
    path = str(tmp_path / "p")

    def die():
        raise RuntimeError("stopped")

    with pytest.raises(RuntimeError, match="stopped"):
        pools.pool_once(spark, path, 3, 42, die)
    assert rows(pools.pool_once(spark, path, 3, 42, lambda: pool)) == ROWS
    with pytest.raises(ValueError, match="size 3, seed 42"):
        pools.pool_once(spark, path, 3, 43, die)


def test_result_document_round_trip(spark, tmp_path):
    iterations = spark.createDataFrame(
        [(1, 0.7, 0.2, 5), (0, 0.5, None, 0), (2, 0.6, -0.1, 9)],
        "iteration int, val_f1 double, reward double, curated_total bigint",
    ).repartition(3)
    regimes = spark.createDataFrame(
        [("real_only", 0.5, 0.4), ("naive_augmentation", 0.8, 0.7), ("bandit_guided", 0.6, 0.55)],
        "regime string, val_f1 double, test_f1 double",
    )
    results.write_result(results.result_document(iterations, regimes), str(tmp_path / "r"))
    assert results.read_result(spark, str(tmp_path / "r")).first().asDict(recursive=True) == {
        "baseline_real_only": {"val_f1": 0.5, "test_f1": 0.4},
        "naive_augmentation": {"val_f1": 0.8, "test_f1": 0.7},
        "bandit_guided": {
            "val_f1_history": [0.5, 0.7, 0.6],
            "reward_history": [0.2, -0.1],
            "curated_pool_size": 9,
            "test_f1": 0.55,
        },
    }


def test_colliding_ids_get_a_key_and_repeated_ones_are_refused(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b")], "id bigint, text string")
    right = spark.createDataFrame([(1, "c")], "id bigint, text string")
    both = union_keyed({"left": left, "right": right})
    assert {r["key"]: r["text"] for r in both.collect()} == {"left:1": "a", "left:2": "b", "right:1": "c"}
    assert unique(both, "key").count() == 3
    with pytest.raises(ValueError, match="does not name one row"):
        unique(both, "id")
