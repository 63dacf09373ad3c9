import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.functions.grouped import last_boundary, map_sorted_groups, spread, stream_groups
from tidemark.functions.keys import norm_key


def test_last_boundary():
    t = pa.table({"a": ["x", "x", "y", "y"], "b": [1, 1, 1, 2]})
    assert last_boundary(t, ["a"]) == 2 and last_boundary(t, ["a", "b"]) == 3
    assert last_boundary(pa.table({"a": [None, None]}), ["a"]) == 0 and last_boundary(pa.table({"a": ["x", None]}), ["a"]) == 1


@pytest.mark.parametrize("chunk", [1, 3, 7, 1000])
def test_chunks_hold_whole_groups_in_order(spark, chunk):
    rng = np.random.default_rng(3)
    rows = [(None if k == 9 else f"k{k}", i) for i, k in enumerate(rng.integers(0, 10, 300).tolist())]
    seen = []

    def fn(frame: pd.DataFrame) -> pd.DataFrame:
        return frame.groupby("k", dropna=False, sort=False)["v"].agg(n="size", least="min", most="max", up=lambda v: v.is_monotonic_increasing).reset_index()

    df = spark.createDataFrame(rows, "k string, v long")
    got = map_sorted_groups(df, ["k"], ["v"], fn, "k string, n long, least long, most long, up boolean", chunk_rows=chunk).collect()
    want = pd.DataFrame(rows, columns=["k", "v"]).groupby("k", dropna=False)["v"].agg(["size", "min", "max"])
    assert sorted((str(r.k), r.n, r.least, r.most) for r in got) == sorted((str(None if k != k else k), *map(int, v)) for k, v in zip(want.index, want.to_numpy()))
    assert all(r.up for r in got) and not seen


def test_empty_batches_and_results():
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("v", T.LongType())])
    run = stream_groups(["v"], lambda f: f.iloc[:0], schema, 2)
    batch = pa.RecordBatch.from_pydict({"v": pa.array([1, 1, 2], pa.int64())})
    assert list(run(iter([batch.slice(0, 0), batch]))) == [] and list(run(iter([]))) == []


def test_spread_only_small_tables(spark):
    few = spark.range(10, numPartitions=1)
    assert spread(few).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    many = spark.range(10, numPartitions=50)
    assert spread(many).rdd.getNumPartitions() == 50


def test_keys(spark):
    df = spark.createDataFrame([(" ab\t",), ("\xa0A b\n",), ("  ",), ("",), (None,), ("ß",)], "k string")
    assert [r.k for r in df.select(norm_key("k").alias("k")).collect()] == ["AB", "A B", None, None, None, "SS"]
    assert [r.k for r in df.select(norm_key(F.concat("k", F.lit("x"))).alias("k")).limit(1).collect()] == ["AB\tX"]
