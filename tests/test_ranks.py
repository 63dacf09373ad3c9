"""Ranks, quantiles and bootstrap intervals of groups that are cut into shards, against plain numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import evaluation, features
from tidemark.operators.ranks import bucketed, exact_quantiles, with_ranks


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    group = rng.choice(["hot", "hot", "hot", "a", "b"], 900)
    value = np.where(rng.random(900) < 0.3, 1.5, np.round(rng.normal(size=900), 1))
    frame = pd.DataFrame({"g": group, "i": rng.permutation(900), "v": value, "w": rng.normal(size=900)})
    return frame, spark.createDataFrame(frame).withColumn("key", F.lit("clash")).withColumn("t", F.lit(1))


@pytest.mark.parametrize("hot", [7, 100, 10_000])
def test_ranks_do_not_depend_on_shards(rows, hot):
    frame, df = rows
    got = with_ranks(df, ["g"], {"a": "v", "b": "w", "c": ("v", "i")}, hot).toPandas().sort_values("i").reset_index(drop=True)
    want = frame.sort_values("i").reset_index(drop=True)
    for name, column in (("a", "v"), ("b", "w")):
        assert (got[f"{name}_low"] == want.groupby("g")[column].rank(method="min")).all() and (got[f"{name}_high"] == want.groupby("g")[column].rank(method="max")).all()
    assert set(got["key"]) == {"clash"}
    order = want.sort_values(["v", "i"]).groupby("g").cumcount() + 1
    assert (got["c_row"] == order.sort_index()).all() and (got["_n"] == want.groupby("g")["v"].transform("size")).all()


@pytest.mark.parametrize("hot", [7, 10_000])
def test_quantiles_and_winsorising(rows, hot):
    frame, df = rows
    at = [0.0, 0.2, 0.5, 0.995, 1.0]
    got = {r.g: r.quantiles for r in exact_quantiles(df.withColumn("v", F.when(F.col("i") % 7 > 0, F.col("v"))), ["g"], "v", at, hot_rows=hot).collect()}
    for g, part in frame[frame.i % 7 > 0].groupby("g"):
        assert got[g] == pytest.approx(np.quantile(part.v, at))
    clipped = features.winsorize(df.unionByName(df.limit(1).withColumn("w", F.lit(None).cast("double"))), "w", 0.1, 0.9).toPandas().w
    low, high = np.quantile(frame.w, [0.1, 0.9])
    assert clipped.isna().sum() == 1 and clipped.min() == pytest.approx(low) and clipped.max() == pytest.approx(high)


def test_buckets_do_not_depend_on_shards(rows):
    _, df = rows
    plain = {r.i: r.bucket for r in bucketed(df, ["g"], "v", "i", 5).collect()}
    assert plain == {r.i: r.bucket for r in bucketed(df, ["g"], "v", "i", 5, hot_rows=9).collect()}


@pytest.mark.parametrize("n", [2, 3, 4, 5, 6, 7, 8, 10, 12, 20])
def test_buckets_of_any_number_equal_quantile_cuts_of_ranks(spark, n):
    sizes = [2, 3, 5, 7, 11, 13, 21, 31, 61, 121, 241]
    frame = pd.DataFrame([(g, i) for g in sizes for i in range(g)], columns=["g", "i"])
    got = bucketed(spark.createDataFrame(frame), ["g"], "i", "i", n).toPandas().sort_values(["g", "i"])
    for g, part in got.groupby("g"):
        assert part.bucket.tolist() == (pd.qcut(pd.Series(range(1, g + 1)), n, labels=False) + 1).tolist(), g


def test_metrics_do_not_depend_on_shards(rows):
    _, df = rows
    told = df.select(F.col("g").alias("model"), F.col("v").alias("prediction"), F.col("w").alias("actual"))
    a, b = (evaluation.group_metrics(told, ["model"], hot).toPandas().sort_values("model").set_index("model") for hot in (11, 10_000))
    assert np.allclose(a, b)


def direct(p, a, metric, draws=200, seed=42):
    """Rows drawn one by one."""
    n = len(p)
    size = max(5, n // 20)
    first = np.random.default_rng(seed).integers(0, max(1, n - size + 1), size=(draws, n // size + 1))
    found = []
    for starts in first:
        at = (starts[:, None] + np.arange(size)).ravel()[:n]
        x, y = p[at], a[at]
        if metric == "pearson":
            if x.std() > 0 and y.std() > 0:
                found.append(np.corrcoef(x, y)[0, 1])
        else:
            q = np.quantile(x, [0.2, 0.8])
            found.append(y[x >= q[1]].mean() - y[x <= q[0]].mean())
    return np.percentile(found, [2.5, 97.5])


@pytest.mark.parametrize("metric", ["pearson", "top_minus_bottom"])
@pytest.mark.parametrize("n", [20, 57, 400])
def test_bootstrap_from_block_sums_equals_drawing_rows(spark, metric, n):
    rng = np.random.default_rng(n)
    p = np.round(rng.normal(size=n), 1)
    a = 1e3 + p + rng.normal(size=n)
    frame = pd.DataFrame({"model": "m", "fold": [f"f{i * 3 // n}" for i in range(n)], "event_id": [f"{i:05}" for i in range(n)], "prediction": p, "actual": a})
    few = frame.head(5).assign(model="few")
    flat = frame.assign(model="flat", prediction=1.0)
    got = {r.model: (r.low, r.high) for r in evaluation.block_bootstrap(spark.createDataFrame(pd.concat([frame, few, flat])), ["model"], ["fold", "event_id"], metric=metric).collect()}
    assert got["m"] == pytest.approx(direct(p, a, metric)) and got["few"] == (None, None)
    assert got["flat"] == (None, None) or metric == "top_minus_bottom"


def test_bootstrap_bins_stay_close(spark):
    rng = np.random.default_rng(5)
    p = rng.normal(size=6000)
    a = p + rng.normal(size=6000)
    df = spark.createDataFrame(pd.DataFrame({"model": "m", "fold": "f", "event_id": np.arange(6000), "prediction": p, "actual": a}))
    r = evaluation.block_bootstrap(df, ["model"], ["fold", "event_id"], metric="top_minus_bottom").first()
    assert (r.low, r.high) == pytest.approx(direct(p, a, "top_minus_bottom"), rel=0.01)
    with pytest.raises(ValueError):
        evaluation.block_bootstrap(df, ["model"], ["fold", "event_id"], metric="nothing")
