import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators.rolling import rolling_totals


@pytest.mark.parametrize("shard", [8, 31, 512])
def test_matches_brute_force_whatever_the_shards(spark, shard):
    rng = np.random.default_rng(5)
    base = datetime.date(2024, 1, 1)
    rows = [(str(rng.choice(["hot", "hot", "a"])), base + datetime.timedelta(days=int(rng.integers(120))), None if i % 13 == 0 else float(rng.integers(-3, 9))) for i in range(120)]
    rows += [(None, base, 2.0), ("x", None, 4.0), ("solo", base, 1.0)]
    df = spark.createDataFrame(rows, "s string, d date, v double").withColumn("shard", F.lit("clash"))
    got = {(r.s, r.day_no): (r.total_v_3, r.total_v_8, r.mean_v_8) for r in rolling_totals(df.select("s", "d", "v"), ["s"], "d", ["v"], [3, 8], shard).collect()}
    want = {}
    for s in {r[0] for r in rows}:
        days = {}
        for k, d, v in rows:
            if k == s and d is not None:
                days[(d - datetime.date(1970, 1, 1)).days] = days.get((d - datetime.date(1970, 1, 1)).days, 0.0) + max(v or 0.0, 0.0)
        if days:
            for n in range(min(days), max(days) + 1):
                t3, t8 = sum(days.get(n - k, 0.0) for k in range(3)), sum(days.get(n - k, 0.0) for k in range(8))
                want[(s, n)] = (t3, t8, t8 / 8)
    assert got == want


def test_empty(spark):
    assert rolling_totals(spark.createDataFrame([], "s string, d date, v double"), ["s"], "d", ["v"], [7]).collect() == []
