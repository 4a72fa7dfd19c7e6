import hashlib

import pytest
from pyspark.sql import functions as F

from gleanspark.operators import ordering, prefix, rewards


def bits(tag, row_id, seed=42):
    return int(hashlib.md5(f"{tag}:{seed}:{row_id}".encode()).hexdigest()[:13], 16)


def shuffled(tag, ids):
    return sorted(ids, key=lambda i: (bits(tag, i), i))


def test_batches_follow_the_hash_order(spark):
    found = ordering.in_batches(spark.range(1000).withColumnRenamed("id", "cand_id"), "cand_id", 50, 42)
    rows = {r["t"]: r for r in found.collect()}
    assert [rows[t]["cand_id"] for t in range(1, 1001)] == shuffled("pool", range(1000))
    assert all(rows[t]["batch_no"] == (t - 1) // 50 + 1 for t in rows)


def test_order_does_not_depend_on_partitions_or_input_order(spark):
    ids = spark.range(500).withColumnRenamed("id", "cand_id")
    a = ordering.in_batches(ids.repartition(1), "cand_id", 7, 1)
    b = ordering.in_batches(ids.orderBy(F.desc("cand_id")).repartition(9), "cand_id", 7, 1)
    assert a.exceptAll(b).count() == 0


def test_take_shuffled(spark):
    found = ordering.take_shuffled(spark.range(1000), "id", 37, 42)
    assert sorted(r["id"] for r in found.collect()) == sorted(shuffled("shuffle", range(1000))[:37])


def test_equal_hashes_are_ordered_by_id(spark):
    chunk = F.lit(0)
    found = ordering.numbered(spark.range(50).repartition(5), chunk, [chunk, F.col("id")], "n")
    assert all(r["n"] == r["id"] + 1 for r in found.collect())


@pytest.mark.parametrize("rows, sizes", [(1000, [500, 200, 200]), (600, [500, 100, 0]), (0, [0, 0, 0])])
def test_fixed_splits_shorten_from_the_end(spark, rows, sizes):
    wanted = {"train": 500, "val": 200, "test": 200}
    found = ordering.fixed_splits(spark.range(rows), "id", wanted, 42)
    counts = {r["split"]: r["count"] for r in found.groupBy("split").count().collect()}
    assert [counts.get(s, 0) for s in wanted] == sizes
    assert found.select("id").distinct().count() == min(rows, 900)


def test_band_splits_are_disjoint_and_whole(spark):
    found = ordering.band_splits(spark.range(5000), "id", {"train": 0.25, "val": 0.1}, "pool", 42)
    shares = {r["split"]: r["count"] / 5000 for r in found.groupBy("split").count().collect()}
    assert shares["train"] == pytest.approx(0.25, abs=0.02)
    assert shares["val"] == pytest.approx(0.1, abs=0.02)
    assert sum(shares.values()) == pytest.approx(1.0)


@pytest.mark.parametrize("n", [0, 1, 10, 25, 99])
def test_first_in_order(spark, monkeypatch, n):
    monkeypatch.setattr(ordering, "MIN_CHUNK_ROWS", 7)
    accepted = spark.range(25).select((F.col("id") * 13 + 1).alias("t"))
    found = ordering.first_in_order(accepted, "t", n)
    assert sorted((r["place"], r["t"]) for r in found.collect()) == [
        (i + 1, i * 13 + 1) for i in range(min(n, 25))
    ]


def events(spark):
    """Run 0 holds most rows and spans segments; others, the NULL run too, hold a few each."""
    run = F.when(F.col("id") % 4 > 0, 0).when(F.col("id") % 60 < 56, F.col("id") % 60)
    value = ((F.col("id") * 7919) % 1000 / 100).cast("decimal(18,2)")
    arm = (F.col("id") % 2).cast("int")
    return spark.range(2000).select(run.alias("run"), "id", value.alias("value"), arm.alias("arm"))


def expected_logs(rows):
    """Rewards and the state before each, one row after the other."""
    logs, last = {}, {}
    for r in sorted(rows, key=lambda r: r["id"]):
        if r["run"] in last:
            logs.setdefault(r["run"], []).append((r["arm"], float(r["value"] - last[r["run"]])))
        last[r["run"]] = r["value"]
    return logs


def test_running_values_cross_segments(spark):
    table = events(spark)
    cut = prefix.in_segments(table.repartition(3), ["run"], ["id"], 8)
    assert cut.filter("run = 0").select("segment").distinct().count() > 1
    log = rewards.reward_log(cut, ["run"], ["id"]).drop("segment", "id")
    expected = expected_logs(table.collect())
    found = {}
    for r in log.orderBy("run", "iteration").collect():
        found.setdefault(r["run"], []).append((r["arm"], float(r["reward"])))
        assert r["iteration"] == len(found[r["run"]])
    assert found == expected

    again = prefix.in_segments(log, ["run"], ["iteration"], 8)
    for r in rewards.state_before_each(again, ["run"]).collect():
        earlier = expected[r["run"]][: r["iteration"] - 1]
        for arm in (0, 1):
            mine = [reward for a, reward in earlier if a == arm]
            won = sum(reward > 0 for reward in mine)
            assert r[f"pulls_{arm}"] == len(mine)
            assert r[f"mean_{arm}"] == pytest.approx(sum(mine) / len(mine) if mine else 0, abs=1e-9)
            assert (r[f"alpha_{arm}"], r[f"beta_{arm}"]) == (1 + won, 1 + len(mine) - won)


def test_running_with_no_keys_and_no_rows(spark):
    table = spark.createDataFrame([], "t bigint, value double")
    cut = prefix.in_segments(table, [], ["t"])
    assert prefix.running(cut, [], ["t"], sums={"total": F.col("value")}).count() == 0
