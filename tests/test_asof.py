import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions.shards import time_shards
from tidemark.operators.asof import asof_join, bitemporal_asof, reduced, undominated

DAY = 86_400_000_000
NEVER = np.iinfo("int64").max


def simple(events, versions):
    out = []
    for e, k, t in events:
        best = [(vt, -i) for vk, vt, i in versions if k is not None and t is not None and vk == k and vt is not None and vt < t]
        if best:
            out.append((e, -max(best)[1]))
    return sorted(out)


@pytest.mark.parametrize("hot", [5, 40, 10_000])
def test_asof_matches_brute_force(spark, hot):
    rng = random.Random(2)
    key = lambda: rng.choice(["h"] * 5 + list("abcd") + [None])
    events = [(f"e{i}", key(), rng.choice([None, rng.randrange(60)]) if i % 9 == 0 else rng.randrange(60)) for i in range(200)]
    versions = [(key(), rng.choice([None, 3]) if i % 11 == 0 else rng.randrange(60), rng.randrange(1000)) for i in range(200)]
    left = spark.createDataFrame(events, "event_id string, key string, t long").withColumn("id", F.lit("clash"))
    right = spark.createDataFrame(versions, "key string, t long, id long").withColumn("event_id", F.lit("clash"))
    got = sorted(map(tuple, asof_join(left, right, hot_rows=hot).collect()))
    assert got == simple(events, versions)


def bitemporal(events, versions):
    out = []
    for e, k, t in events:
        day = (t - 5 * 3_600_000_000) // DAY  # New York winter
        fit = [(v, r, -i) for vk, i, v, r, d in versions if vk == k and v is not None and v <= day and r is not None and r < t and (d is None or d > t)]
        if fit:
            out.append((e, -max(fit)[2]))
    return sorted(out)


@pytest.mark.parametrize("hot", [6, 50, 10_000])
def test_bitemporal_matches_brute_force(spark, hot):
    rng = random.Random(3)
    key = lambda: rng.choice(["h"] * 4 + list("ab"))
    when = lambda: rng.randrange(1, 60) * DAY + rng.randrange(3) * DAY // 3
    events = [(f"e{i}", key(), when()) for i in range(250)]
    versions = [(key(), i, rng.choice([None] + [rng.randrange(70)] * 9), when(), rng.choice([None, None, when()])) for i in range(250)]
    left = spark.createDataFrame(events, "event_id string, key string, t long")
    right = spark.createDataFrame(versions, "key string, id long, valid int, recorded long, deleted long")
    got = sorted(map(tuple, bitemporal_asof(left, right, hot_rows=hot).collect()))
    assert got == bitemporal(events, versions)


def test_empty(spark):
    left = spark.createDataFrame([("e", "a", 5)], "event_id string, key string, t long")
    right = spark.createDataFrame([], "key string, t long, id long")
    assert asof_join(left, right).collect() == []
    assert asof_join(left.limit(0), right).collect() == []
    assert bitemporal_asof(left, spark.createDataFrame([], "key string, id long, valid int, recorded long, deleted long")).collect() == []


def test_undominated_keeps_what_can_win_later():
    old, better, ahead = (1, 10, 0, 100), (2, 20, 0, 50), (9, 5, 0, 70)
    assert set(undominated([old, better, ahead], 5)) == {old, better, ahead}
    assert set(undominated([(1, 10, 0, 40), better], 5)) == {better}


def test_long_chains_of_failing_versions(spark):
    """Events that pass over more versions than are tried at once still get the right one."""
    versions = [("a", i, 5 + i // 4, 50 * DAY + i, None) for i in range(300)] + [("a", 999, 1, DAY, None), ("b", 1000, 3, 2 * DAY, None)]
    events = [("e1", "a", 49 * DAY), ("e2", "a", 51 * DAY), ("e3", "b", 40 * DAY), ("e4", "a", DAY // 2), ("e5", "a", 51 * DAY)]
    left = spark.createDataFrame(events, "event_id string, key string, t long")
    right = spark.createDataFrame(versions, "key string, id long, valid int, recorded long, deleted long")
    assert sorted(map(tuple, bitemporal_asof(left, right).collect())) == bitemporal(events, versions)


def test_a_shard_is_reduced_to_what_can_win_later():
    rng = random.Random(5)
    rows = sorted((k, s, rng.randrange(40), rng.randrange(100), -i, rng.choice([NEVER, rng.randrange(100, 200)]), 10 * s + 9) for i, (k, s) in enumerate((rng.choice("ab"), rng.randrange(3)) for _ in range(300)))
    frame = pd.DataFrame(rows, columns=["key", "shard", "valid", "recorded", "neg", "deleted", "until"])
    got = reduced(frame)
    for (k, s), part in frame.groupby(["key", "shard"]):
        want = set(undominated([tuple(r) for r in part[["valid", "recorded", "neg", "deleted"]].itertuples(index=False)], 10 * s + 9))
        assert {tuple(r) for r in got[(got.key == k) & (got.shard == s)][["valid", "recorded", "neg", "deleted"]].itertuples(index=False)} == want


@pytest.mark.parametrize("most", [3, 10, 10_000])
def test_hot_keys_and_bounds_are_bounded(spark, most):
    rows = spark.range(3000).selectExpr("concat('k', id % 10 * (id % 3)) AS key", "id AS t")
    shard, bounds = time_shards(rows, 20, most)
    got = bounds.collect()
    assert len(got) <= most and sum(len(r.bounds) for r in got) <= most
    if most > 10:
        sizes = [r["count"] for r in rows.join(bounds, "key", "left").withColumn("shard", shard).groupBy("key", "shard").count().collect()]
        assert max(sizes) <= 60 and np.sum(sizes) == 3000
