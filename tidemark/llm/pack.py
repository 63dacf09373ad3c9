"""Filling fixed-capacity containers with items by multiway differencing.

Items are dealt to groups by a hash of their id, and each group is packed on its own by
the Karmarkar-Karp differencing method: partial partitions with opposing imbalances are
merged, the most unbalanced first, which leaves containers of nearly equal load. The
number of containers starts at the least possible and rises, by what is over capacity,
until nothing is.

Only an item larger than a container is split: its full containers stand alone and the
rest is packed like any other item.

Defined cases: items of null, zero or negative size take no room and come out nowhere;
equal sizes are taken in order of id; repeated rows of an id are items of their own; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.grouped import map_sorted_groups


def difference(sizes: np.ndarray, k: int) -> np.ndarray:
    """Splits items into ``k`` containers of nearly equal load; returns each item's container.

    A partial partition is a list of loads in falling order (loads of 0 left out, the least
    load taken off if there are ``k``) with a node behind each load: an item, or two nodes
    that were put together. The two partitions of largest spread are merged, the largest
    load of one with the smallest of the other. A partition with fewer than ``k`` loads keeps
    its spread while single items join it, so these are taken along in one step.
    """
    order = np.argsort(-sizes, kind="stable")
    singles, taken, n = sizes[order], 0, len(sizes)
    tick, heap, pairs, fresh = count(), [], [], n

    def push(loads: np.ndarray, nodes: np.ndarray) -> None:
        falling = np.argsort(-loads, kind="stable")
        loads, nodes = loads[falling], nodes[falling]
        if len(loads) == k:
            loads = loads - loads[-1]
        heapq.heappush(heap, (-int(loads[0]), next(tick), loads, nodes))

    def largest() -> tuple[np.ndarray, np.ndarray]:
        nonlocal taken
        if taken < n and (not heap or singles[taken] >= -heap[0][0]):
            taken += 1
            return singles[taken - 1 : taken], order[taken - 1 : taken]
        return heapq.heappop(heap)[2:]

    while n - taken + len(heap) > 1:
        a, behind_a = largest()
        lead = -heap[0][0] if heap else 0
        joined = min(k - len(a), int(np.searchsorted(-singles[taken:], -lead, "right")))
        if joined > 0:
            push(np.concatenate([a, singles[taken : taken + joined]]), np.concatenate([behind_a, order[taken : taken + joined]]))
            taken += joined
            continue
        b, behind_b = largest()
        over = max(0, len(a) + len(b) - k)
        met = slice(len(a) - over, len(a))
        both = a[met] + b[::-1][:over]
        pairs.append((fresh, behind_a[met], behind_b[::-1][:over]))
        nodes = np.concatenate([behind_a[: len(a) - over], np.arange(fresh, fresh + over), behind_b[: len(b) - over]])
        fresh += over
        push(np.concatenate([a[: len(a) - over], both, b[: len(b) - over]]), nodes)
    container = np.zeros(fresh, dtype="int64")
    nodes = heap[0][3] if heap else order
    container[nodes] = np.arange(len(nodes))
    for start, left, right in reversed(pairs):
        container[left] = container[right] = container[start : start + len(left)]
    return container[:n]


def pack(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container of each item, none over ``capacity``; every size is at most that."""
    if not len(sizes):
        return np.array([], dtype="int64")
    # items of more than half a container each need their own
    k = max(1, -(-int(sizes.sum()) // capacity), int((sizes * 2 > capacity).sum()))
    while True:
        found = difference(sizes, k) if k < len(sizes) else np.arange(len(sizes))
        over = np.maximum(np.bincount(found, weights=sizes) - capacity, 0).sum()
        if not over:
            return found
        k += max(1, int(over) // capacity)


def pack_groups(doc_id: str, capacity: int):
    def run(chunk: pd.DataFrame) -> pd.DataFrame:
        out = []
        for group, rows in chunk.groupby("bin", sort=False):
            ids, size = rows[doc_id].to_numpy(), rows["n_tokens"].to_numpy()
            full, rest = size // capacity, size % capacity
            item = np.repeat(np.arange(len(ids)), full)
            piece = np.arange(len(item)) - np.repeat(np.cumsum(full) - full, full)
            left = np.flatnonzero(rest)
            slot = pack(rest[left], capacity)
            placed = np.argsort(slot, kind="stable")
            at, slot = left[placed], slot[placed]
            begin = np.cumsum(rest[at]) - rest[at]
            first = np.r_[True, slot[1:] != slot[:-1]] if len(slot) else np.array([], dtype=bool)
            start = begin - np.maximum.accumulate(np.where(first, begin, 0))
            zero = np.zeros(len(item), dtype="int64")
            out.append(
                pd.DataFrame(
                    {
                        "container_id": (int(group) << 32) + np.r_[np.arange(len(item)), len(item) + slot], doc_id: ids[np.r_[item, at].astype(int)], "token_start": np.r_[piece * capacity, full[at] * capacity],
                        "n_tokens": np.r_[zero + capacity, rest[at]], "container_start": np.r_[zero, start],
                    }
                )
            )
        return pd.concat(out)

    return run


def fill_containers(items: DataFrame, doc_id: str = "doc_id", size: str = "n_tokens", capacity: int = 2048, group_items: int = 4000, expected: int | None = None, most_tasks: int = 10_000) -> DataFrame:
    """container_id, doc_id, token_start, n_tokens, container_start: which tokens of which item lie where in which container.

    ``group_items``: about how many items are packed together; ``expected``: the number of
    items if the caller knows it (else they are counted, which computes them once more).
    """
    real = items.where(F.col(size) > 0).select(doc_id, F.col(size).cast("long").alias("n_tokens"))
    groups = max(1, round((items.count() if expected is None else expected) / group_items))
    dealt = real.withColumn("bin", F.pmod(F.xxhash64(doc_id), F.lit(groups)).cast("int"))
    kind = dict(items.dtypes)[doc_id]
    schema = f"container_id long, `{doc_id}` {kind}, token_start long, n_tokens long, container_start long"
    # lengths are few bytes but packing is work, so partitions are set by groups, not merged by size
    tasks = min(groups, most_tasks)
    placed = dealt.repartitionById(tasks, F.pmod("bin", F.lit(tasks)).cast("int"))
    return map_sorted_groups(placed, ["bin"], [F.col("n_tokens").desc(), doc_id], pack_groups(doc_id, capacity), schema, chunk_rows=16_384, clustered=True)
