"""References to records that do not exist.

Keys are range-partitioned on their 64-bit hash, each range (unit) keeps its parents as
sorted arrays, and reference batches probe them by vectorised binary search. Ranges are
cut from one histogram over 2^CELL_BITS hash cells. A unit holds ``unit_rows`` rows, or
so many more that there are never more units than cells. Only a key with more references
than a unit should hold is salted: its references are spread over units of its own, and
its one parent row is replicated to these. So the parents shuffled are those there are,
plus one row per salt. Only misses leave the probe.

Defined cases: a null or blank key refers to nothing and is never a miss; an empty
parent table makes every reference 'missing'; a null arrival is no arrival, so such a
parent never makes a reference late, and neither does a null load stamp of the
reference; repeated reference rows are each judged; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.keys import micros, norm_key

CELL_BITS = 14
MISS = "table_name string, row_id long, ref_month string, reason string"
REASONS = np.array(["missing", "deleted", "late"], dtype=object)


@dataclass(frozen=True)
class Parents:
    """A referred table: its key, when each row arrived, and the mark of deleted rows."""

    name: str
    df: DataFrame
    key: str
    arrived: str
    deleted: str


@dataclass(frozen=True)
class References:
    """A referring table: its key into ``parent``, row id, period stamp and load stamp."""

    name: str
    df: DataFrame
    parent: str
    key: str
    row_id: str
    stamp: str
    loaded: str


def cut_ranges(rows_of_cell: np.ndarray, rows: int) -> np.ndarray:
    """Unit of each hash cell: neighbouring cells share one while together they hold at most ``rows``."""
    units, unit, held = [], 0, 0
    for n in rows_of_cell.tolist():
        if held and held + n > rows:
            unit, held = unit + 1, 0
        units.append(unit)
        held += n
    return np.array(units)


def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Binary search of each batch of references in its unit's sorted parents, which come first."""
    unit, parts, ready = None, [], None
    for batch in batches:
        frame = batch.to_pandas()
        units = frame["unit"].to_numpy()
        for lo, hi in zip(*bounds(units)):
            part = frame.iloc[lo:hi]
            if units[lo] != unit:
                unit, parts, ready = units[lo], [], None
            mine = part["kind"].to_numpy() == 0
            if mine.any():
                parts.append(part.loc[mine, ["h", "key", "live", "arrived"]])
            if mine.all():
                continue
            if ready is None:
                ready = [np.concatenate([x[c].to_numpy() for x in parts]) if parts else np.array([], dtype="int64") for c in ("h", "key", "live", "arrived")]
            misses = judge(part.loc[~mine], *ready)
            if misses.num_rows:
                yield misses


def bounds(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.array([], dtype=int)
    return at, np.r_[at[1:], len(values)] if len(at) else at


def judge(refs, hashes: np.ndarray, keys: np.ndarray, live: np.ndarray, arrived: np.ndarray) -> pa.RecordBatch:
    want, wanted = refs["h"].to_numpy(), refs["key"].to_numpy()
    at, end = np.searchsorted(hashes, want, "left"), np.searchsorted(hashes, want, "right")
    found = np.full(len(want), -1)
    step = 0
    while True:  # one round, but for keys that share a 64-bit hash
        open_ = np.flatnonzero((found < 0) & (at + step < end))
        if not len(open_):
            break
        hit = keys[at[open_] + step] == wanted[open_]
        found[open_[hit]] = (at[open_] + step)[hit]
        step += 1
    code = np.full(len(want), -1)
    code[found < 0] = 0
    have = np.flatnonzero(found >= 0)
    dead = live[found[have]] == 0
    code[have[dead]] = 1
    loaded, first = refs["arrived"].to_numpy(dtype="float64", na_value=np.nan)[have], arrived[found[have]].astype("float64")
    code[have[~dead & (first > loaded)]] = 2
    out = refs.loc[code >= 0]
    return pa.RecordBatch.from_arrays(
        [pa.array(out["table_name"], pa.string()), pa.array(out["row_id"], pa.int64()), pa.array(out["ref_month"], pa.string()), pa.array(REASONS[code[code >= 0]], pa.string())],
        names=["table_name", "row_id", "ref_month", "reason"],
    )


def looked_up(values: np.ndarray, at: Column) -> Column:
    """A value of a literal array; as text, since a literal list goes to the JVM one element at a time."""
    return F.get(F.expr(f"array({','.join(map(str, values.tolist()))})"), at)


def find_orphans(parents: list[Parents], references: list[References], unit_rows: int = 200_000, cell_bits: int = CELL_BITS) -> DataFrame:
    """One row per reference whose target is missing, deleted or late: table_name, row_id, ref_month, reason.

    ``unit_rows``: rows (parents and references) a probe unit holds, as long as that makes
    no more units than the 2^``cell_bits`` cells. At most that many hot keys reach the
    driver and are broadcast, whatever the input: each has over a cell's mean share of all rows.
    """
    hashed = lambda name, key: F.xxhash64(F.lit(name), key)

    def parent_side(p: Parents) -> DataFrame:
        alive = F.col(p.deleted).isNull()
        keyed = p.df.select(norm_key(p.key).alias("key"), alive.cast("int").alias("live"), F.when(alive, micros(p.arrived)).alias("arrived"))
        grouped = keyed.where("key is not null").groupBy("key").agg(F.max("live").alias("live"), F.min("arrived").alias("arrived"))
        return grouped.withColumn("h", hashed(p.name, F.col("key"))).withColumn("key", F.concat(F.lit(f"{p.name}/"), "key"))

    def reference_side(r: References) -> DataFrame:
        keyed = r.df.select(
            norm_key(r.key).alias("key"), F.lit(r.name).alias("table_name"), F.col(r.row_id).cast("long").alias("row_id"), F.date_format(r.stamp, "yyyy-MM").alias("ref_month"), micros(r.loaded).alias("arrived")
        ).where("key is not null")
        return keyed.withColumn("h", hashed(r.parent, F.col("key"))).withColumn("key", F.concat(F.lit(f"{r.parent}/"), "key"))

    left = reduce(DataFrame.unionByName, map(parent_side, parents)).withColumn("kind", F.lit(0))
    right = reduce(DataFrame.unionByName, map(reference_side, references)).withColumn("kind", F.lit(1))
    both, units = place(left, right, unit_rows, cell_bits)
    ordered = both.repartitionById(max(1, units), F.col("unit")).sortWithinPartitions("unit", "kind", "h")
    return ordered.select("unit", "kind", "h", "key", "live", "arrived", "table_name", "row_id", "ref_month").mapInArrow(probe, MISS)


def place(left: DataFrame, right: DataFrame, unit_rows: int, cell_bits: int) -> tuple[DataFrame, int]:
    """Parents (kind 0) and references (kind 1) with the unit they are probed in, and the number of units."""
    cells = 1 << cell_bits
    cell = (F.shiftright("h", 64 - cell_bits) + (cells >> 1)).cast("int")
    counts = np.zeros((2, cells), dtype="int64")
    # at most 2 * 2^cell_bits rows, whatever the input
    for kind, c, n in left.select("kind", "h").unionByName(right.select("kind", "h")).groupBy("kind", cell.alias("cell")).count().collect():
        counts[kind, c] = n
    rows = max(unit_rows, -(-int(counts.sum()) // cells))
    hot = hot_keys(right, cell, counts[1] > rows, rows)
    for h, n in hot.items():
        counts[1, (h >> (64 - cell_bits)) + (cells >> 1)] -= n
    of_cell = cut_ranges(counts.sum(axis=0), rows)
    units = int(of_cell[-1]) + 1
    unit = looked_up(of_cell, cell)
    if not hot:
        return left.withColumn("unit", unit).unionByName(right.withColumn("unit", unit), allowMissingColumns=True), units
    salts = [-(-n // rows) for n in hot.values()]
    first = units + np.cumsum([0, *salts])
    table = F.broadcast(left.sparkSession.createDataFrame(list(zip(hot, first[:-1].tolist(), salts)), "h long, first int, salts int"))
    dealt = F.col("first") + F.pmod(F.xxhash64("row_id", "arrived"), "salts").cast("int")
    right = right.join(table, "h", "left").withColumn("unit", F.coalesce(dealt, unit))
    own = F.sequence("first", F.col("first") + F.col("salts") - 1)
    left = left.join(table, "h", "left").withColumn("unit", F.explode(F.coalesce(own, F.array(unit))))
    return left.unionByName(right, allowMissingColumns=True).drop("first", "salts"), int(first[-1])


def hot_keys(references: DataFrame, cell: Column, full: np.ndarray, rows: int) -> dict[int, int]:
    """References of each key (by hash) with more than ``rows`` of them. Only the cells marked ``full`` are counted by key."""
    if not full.any():
        return {}
    counted = references.select("h").where(looked_up(full.astype(int), cell) == 1).groupBy("h").count().where(F.col("count") > rows)
    return {r["h"]: r["count"] for r in counted.collect()}  # at most one per ``rows`` references


def orphan_report(misses: DataFrame) -> DataFrame:
    """Misses per table, period and reason."""
    return misses.groupBy("table_name", "ref_month", "reason").agg(F.count(F.lit(1)).alias("n"))
