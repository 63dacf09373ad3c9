import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators.regularize import regularize, session_of, ssa_fill


def grid(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("bucket", [4, 16, 512])
def test_grid_does_not_depend_on_buckets(spark, bucket):
    rng = np.random.default_rng(4)
    rows = []
    for s in ("hot", "b", None):
        for at in rng.choice(200, 30 if s != "hot" else 120, replace=False).tolist():
            rows += [(s, at, float(at), at)] * (1 + at % 2)
    rows += [("one", 5, 1.0, 1), ("void", 5, None, 1), ("b", None, 3.0, 1)]
    df = spark.createDataFrame(rows, "s string, slot int, v double, stamp int").withColumn("filled", F.lit("clash")).withColumn("bucket", F.lit(1))
    got = {(r.s, r.slot, r.filled) for r in regularize(df.select("s", "slot", "v", "stamp", "bucket"), ["s"], "slot", "v", ["stamp"], bucket=bucket).collect()}
    want = set()
    for s in ("hot", "b", None, "one"):
        have = {at for k, at, v, _ in rows if k == s and v is not None and at is not None}
        want |= {(s, at, at not in have) for at in range(min(have), max(have) + 1)}
    assert got == want


def test_latest_reading_of_a_slot_counts(spark):
    df = spark.createDataFrame([("a", 1, 5.0, 1), ("a", 1, 7.0, 3), ("a", 1, 6.0, 2), ("a", 3, 9.0, 1)], "s string, slot int, v double, stamp int")
    assert grid(regularize(df, ["s"], "slot", "v", ["stamp"])) == [("a", 1, 7.0, False), ("a", 2, 8.0, True), ("a", 3, 9.0, False)]


def test_empty(spark):
    df = spark.createDataFrame([], "s string, slot int, v double, stamp int")
    assert regularize(df, ["s"], "slot", "v", ["stamp"]).collect() == []


def test_imputation_beats_straight_lines_on_waves():
    t = np.arange(300)
    true = 50 + 5 * np.sin(t / 5) + 0.01 * t
    gap = np.zeros(300, dtype=bool)
    for a in (40, 120, 200):
        gap[a : a + 9] = True
    start = np.interp(t, t[~gap], true[~gap])
    filled = ssa_fill(start.copy(), gap, 40, 4, 60, 1e-6)
    assert np.abs(filled - true)[gap].mean() < 0.2 * np.abs(start - true)[gap].mean()
    assert np.allclose(filled[~gap], true[~gap])


def test_long_gaps_are_filled_until_they_settle(spark):
    true = 50 + 5 * np.sin(np.arange(160) / 3)
    gap = np.zeros(160, dtype=bool)
    gap[60:80] = True
    df = spark.createDataFrame([("a", i, float(true[i]), i) for i in range(160) if not gap[i]], "s string, slot int, v double, stamp int")
    got = np.array([r.v for r in regularize(df, ["s"], "slot", "v", ["stamp"]).orderBy("slot").collect()])
    assert np.abs(got - true)[gap].mean() < 0.3 and np.allclose(got[~gap], true[~gap])
    settled = {rounds: {r.settled for r in regularize(df, ["s"], "slot", "v", ["stamp"], rounds=rounds, flag="settled").collect()} for rounds in (10, 5000)}
    assert settled == {10: {False}, 5000: {True}}


def test_closed_days_belong_to_the_last_session(spark):
    sessions = spark.createDataFrame([("2024-01-04", 0), ("2024-01-05", 1), ("2024-01-08", 2)], "d string, ord int").select(F.to_date("d").alias("session_date"), "ord")
    df = spark.createDataFrame([("2024-01-03",), ("2024-01-05",), ("2024-01-07",), ("2024-01-08",), ("2024-02-01",), (None,)], "d string").withColumn("d", F.to_date("d"))
    assert sorted(r.o for r in session_of(df, "d", sessions, "o").collect()) == [1, 1, 2, 2]
    assert session_of(df, "d", sessions.limit(0), "o").collect() == []


def plain_imputation(values, window=16, rank=3, tolerance=1e-3):
    """The same by its definition: a full singular value decomposition and antidiagonal means, until the entries settle."""
    gap = np.isnan(values)
    at = np.arange(len(values))
    filled = np.interp(at, at[~gap], values[~gap])
    centre = values[~gap].mean()
    x = filled - centre
    scale = np.abs(x).max()
    window = min(window, len(x) // 2)
    while True:
        k = len(x) - window + 1
        hankel = np.array([[x[i + j] for j in range(k)] for i in range(window)])
        u, s, v = np.linalg.svd(hankel, full_matrices=False)
        low = (u[:, :rank] * s[:rank]) @ v[:rank]
        smooth = np.array([np.mean([low[i, t - i] for i in range(window) if 0 <= t - i < k]) for t in at])
        moved = np.abs(smooth - x)[gap].max()
        x = np.where(gap, smooth, x)
        if moved <= tolerance * scale:
            return x + centre


def test_filled_values_with_production_parameters(spark):
    """Random walks with short and long gaps: every filled value is that of the definition."""
    rng = np.random.default_rng(6)
    rows, want = [], {}
    for name in "abcd":
        walk = 50 * np.exp(np.cumsum(rng.normal(0, 0.02, 200)))
        hidden = rng.random(200) < 0.1
        hidden[60:60 + 15 * (ord(name) - 96)] = True
        hidden[[0, 199]] = False
        rows += [(name, int(i), float(v), 1) for i, v in enumerate(walk) if not hidden[i]]
        want[name] = plain_imputation(np.where(hidden, np.nan, walk))
    df = spark.createDataFrame(rows, "s string, slot int, v double, stamp int")
    got = regularize(df, ["s"], "slot", "v", ["stamp"], flag="settled").toPandas()
    assert got.settled.all()
    for name, part in got.groupby("s"):
        assert part.sort_values("slot").v.to_numpy() == pytest.approx(want[name], rel=1e-6)
