import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm.pack import difference, fill_containers, pack


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60))
def test_every_item_once_and_never_over_capacity(sizes):
    got = pack(np.array(sizes, dtype="int64"), 50)
    assert len(got) == len(sizes)
    assert all(sum(s for s, c in zip(sizes, got) if c == at) <= 50 for at in set(got))


def test_differencing_balances():
    rng = np.random.default_rng(9)
    sizes = np.sort(rng.integers(1, 400, 300))[::-1]
    loads = np.bincount(difference(sizes, 20), weights=sizes)
    assert len(loads) == 20 and max(loads) - min(loads) <= 5


def test_little_room_is_left():
    rng = np.random.default_rng(10)
    sizes = np.minimum(rng.lognormal(5, 1, 1000).astype("int64") + 1, 2048)
    assert sizes.sum() / (len(set(pack(sizes, 2048))) * 2048) > 0.97


def merged_one_by_one(sizes, k):
    """Karmarkar-Karp on lists of loads, one merge at a time; the final spread-off loads."""
    parts = [[s] for s in sizes]
    while len(parts) > 1:
        parts.sort(key=lambda p: -p[0])
        a, b = parts.pop(0), parts.pop(0)
        a, b = a + [0] * (k - len(a)), b + [0] * (k - len(b))
        both = sorted((x + y for x, y in zip(a, reversed(b))), reverse=True)
        parts.append([x - both[-1] for x in both])
    return parts[0][0]


def test_differencing_is_that_of_the_textbook():
    rng = np.random.default_rng(1)
    for _ in range(100):
        k = int(rng.integers(2, 9))
        sizes = rng.choice(10**6, int(rng.integers(k + 1, 60)), replace=False).astype("int64") + 1
        loads = np.bincount(difference(sizes, k), weights=sizes, minlength=k)
        assert loads.max() - loads.min() == merged_one_by_one(sizes.tolist(), k) and loads.sum() == sizes.sum()


def test_more_than_half_a_container_each(spark):
    sizes = np.array([30] * 40 + [5] * 10, dtype="int64")
    got = pack(sizes, 50)
    assert len(set(got[:40])) == 40 and np.bincount(got, weights=sizes).max() <= 50


@pytest.mark.parametrize("group", [3, 1000])
def test_containers(spark, group):
    sizes = [0, None, -4, 1, 5, 5, 10, 11, 25, 30, 9, 1, 7]
    rows = [(i, n, "clash") for i, n in enumerate(sizes)] + [(4, 5, "again")]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens long, bin string")
    got = fill_containers(df, capacity=10, group_items=group).collect()
    load, seen = {}, {}
    for r in got:
        assert r.container_start == load.get(r.container_id, 0) or r.container_start < 10
        load[r.container_id] = load.get(r.container_id, 0) + r.n_tokens
        seen.setdefault(r.doc_id, []).append((r.token_start, r.n_tokens))
    assert max(load.values()) <= 10
    want = {i: n for i, n in enumerate(sizes) if n and n > 0}
    assert {i: sum(n for _, n in p) for i, p in seen.items()} == want | {4: 10}
    assert sorted(seen[8]) == [(0, 10), (10, 10), (20, 5)] and sorted(seen[6]) == [(0, 10)]
    assert fill_containers(df.limit(0)).collect() == []
