import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators.orphans import Parents, References, cut_ranges, find_orphans, orphan_report, place

PARENT = "k string, arrived timestamp, deleted timestamp, row_id string"
CHILD = "id long, k string, stamp timestamp, loaded timestamp, kind int"


def at(day):
    return None if day is None else f"2024-{day}"


def frames(spark, parents, children):
    from datetime import datetime as d

    t = lambda s: None if s is None else d.fromisoformat(f"2024-{s}T00:00:00")
    p = spark.createDataFrame([(k, t(a), t(x), "clash") for k, a, x in parents], PARENT)
    c = spark.createDataFrame([(i, k, t(s), t(x), 7) for i, k, s, x in children], CHILD)
    return p, c


def run(p, c, **options):
    found = find_orphans([Parents("parent", p, "k", "arrived", "deleted")], [References("child", c, "parent", "k", "id", "stamp", "loaded")], **options)
    return sorted((r.row_id, r.ref_month, r.reason) for r in found.collect())


def test_reasons_and_key_forms(spark):
    parents = [("A", "01-05", None), (" b\t", "01-05", "01-06"), ("C", "03-01", None), ("c ", "02-01", "02-02"), (None, "01-01", None), ("  ", "01-01", None), ("N", None, None)]
    children = [(1, " a", "02-01", "02-01"), (2, "B", "02-03", "02-01"), (3, "c", "02-01", "02-15"), (4, "c", "03-01", "03-01"), (5, "zz", None, "02-01"), (6, None, "02-01", "02-01"), (7, " ", "02-01", "02-01"), (8, "n", "02-01", "02-01"), (9, "c", "02-01", None), (5, "zz", None, "02-01")]
    assert run(*frames(spark, parents, children)) == [(2, "2024-02", "deleted"), (3, "2024-02", "late"), (5, None, "missing"), (5, None, "missing")]


def test_empty_tables(spark):
    p, c = frames(spark, [], [(1, "a", "02-01", "02-01")])
    assert run(p, c) == [(1, "2024-02", "missing")]
    assert run(p, c.limit(0)) == []
    assert run(p.limit(0), c.limit(0)) == []


@pytest.mark.parametrize("unit_rows", [7, 50, 10_000])
def test_hot_key_is_salted_without_changing_the_result(spark, unit_rows):
    rng = np.random.default_rng(1)
    parents = [(f"K{i}", "02-10", None if i % 3 else "02-11") for i in range(60)]
    children = [(i, "K1" if rng.random() < 0.4 else f"K{rng.integers(90)}", "02-01", "02-15" if i % 2 else "02-05") for i in range(900)]
    live = {k: x is None for k, _, x in parents}
    want = sorted((i, "2024-02", "missing" if k not in live else "deleted" if not live[k] else "late") for i, k, _, x in children if k not in live or not live[k] or x == "02-05")
    assert run(*frames(spark, parents, children), unit_rows=unit_rows) == want


def test_ranges_cover_all_cells():
    assert cut_ranges(np.array([5, 5, 100, 1, 0, 0]), 10).tolist() == [0, 0, 1, 2, 2, 2]
    assert cut_ranges(np.zeros(4, dtype=int), 10).tolist() == [0, 0, 0, 0]


@pytest.mark.parametrize("cell_bits", [2, 14])
def test_only_hot_keys_are_replicated(spark, cell_bits):
    """With every cell over the limit, parents are shuffled once each; a hot key's parent once per salt."""
    keys = [f"K{i}" for i in range(400)]
    left = spark.createDataFrame([(k,) for k in keys], "key string").select(F.xxhash64("key").alias("h"), "key", F.lit(0).alias("kind"))
    rows = [(k, i) for i in range(20) for k in keys] + [("K7", i) for i in range(4000)]
    right = spark.createDataFrame(rows, "key string, row_id long").select(F.xxhash64("key").alias("h"), "key", "row_id", F.lit(1).alias("kind"), F.lit(0).alias("arrived"))
    both, units = place(left, right, 50, cell_bits)
    seen = both.groupBy("unit").agg(F.count_if(F.col("kind") == 0).alias("p"), F.count_if(F.col("kind") == 1).alias("r")).collect()
    limit = max(50, -(-(len(keys) + len(rows)) // (1 << cell_bits)))
    assert sum(s.p for s in seen) <= 1.2 * len(keys) + 4020 // limit and sum(s.r for s in seen) == len(rows)
    assert max(s.unit for s in seen) < units and max(s.r for s in seen) <= 3 * limit + 20


def test_report(spark):
    rows = spark.createDataFrame([("t", 1, "2024-01", "late"), ("t", 2, "2024-01", "late"), ("u", 1, None, "missing")], "table_name string, row_id long, ref_month string, reason string")
    assert sorted(map(tuple, orphan_report(rows).orderBy(F.col("n")).collect()), key=str) == [("t", "2024-01", "late", 2), ("u", None, "missing", 1)]
