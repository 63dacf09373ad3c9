"""Attributes as known at event time.

``asof_join`` gives each event its last version strictly before the event. Entities with
more rows than ``hot_rows`` are sharded by time at quantile bounds; the last version
before a shard is replicated into it as carry-in, so every shard merges on its own and
no result depends on where it was cut.

``bitemporal_asof`` picks the version that is valid at the event's date among those
recorded before the event and not deleted at it. Its carry-in is the set of versions
that can still win later: the undominated ones. Each shard of a hot entity reduces its own
versions to these; only the reduced sets are run over in order of time.

Rows of one entity and one time are never cut apart.

Defined cases: a null key or time joins nothing; among versions of the same time the
smallest id wins; an empty side gives an empty result; repeated version rows count once
(same id); other columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.grouped import map_sorted_groups
from tidemark.functions.shards import sharded, time_shards

NEVER = np.iinfo("int64").max
#: Versions tried per event at once before the rest of a group goes through the heaps.
TRIES = 64


def asof_join(events: DataFrame, versions: DataFrame, hot_rows: int = 500_000) -> DataFrame:
    """For each event (event_id, key, t) the id of the version (key, t, id) with the latest t strictly before the event's.

    Times are microseconds. Returns event_id, row_id; events without such a version are left out.
    """
    events, versions = events.where("key is not null and t is not null"), versions.where("key is not null and t is not null")
    shard, bounds = time_shards(events.select("key", "t").unionByName(versions.select("key", "t")), hot_rows)
    right = sharded(versions, shard, bounds).select("key", "shard", "t", F.lit(1).alias("kind"), "id", F.lit(None).cast("string").alias("event_id"))
    left = sharded(events, shard, bounds).select("key", "shard", "t", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("id"), "event_id")
    if bounds is not None:
        carried = right.join(F.broadcast(bounds.select("key")), "key", "left_semi")
        last = carried.groupBy("key", "shard").agg(F.max(F.struct("t", (-F.col("id")).alias("neg"))).alias("v"))
        slots = bounds.select("key", F.explode(F.sequence(F.lit(0), F.size("bounds"))).alias("shard"))
        before = Window.partitionBy("key").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
        carry = slots.join(last, ["key", "shard"], "left").withColumn("v", F.last("v", ignorenulls=True).over(before)).where("v is not null")
        right = right.unionByName(carry.select("key", "shard", F.col("v.t").alias("t"), F.lit(1).alias("kind"), (-F.col("v.neg")).alias("id"), F.lit(None).cast("string").alias("event_id")))
    # an event sorts before versions of its own time; of one time's versions the smallest id sorts last
    order = Window.partitionBy("key", "shard").orderBy("t", "kind", F.col("id").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    merged = left.unionByName(right).withColumn("row_id", F.last("id", ignorenulls=True).over(order))
    return merged.where("kind = 0 and row_id is not null").select("event_id", "row_id")


def undominated(versions: list[tuple], day: int) -> list[tuple]:
    """Versions (valid, recorded, -id, deleted) that can still win at or after ``day``."""
    kept, outlives = [], -1
    ahead: dict[int, int] = {}
    for v in sorted(versions, reverse=True):
        if v[0] > day:  # not yet valid: only a better version of the same validity replaces it
            if v[3] > ahead.get(v[0], -1):
                ahead[v[0]] = v[3]
                kept.append(v)
        elif v[3] > outlives:
            outlives = v[3]
            kept.append(v)
    return kept


def groups_of(chunk: pd.DataFrame) -> np.ndarray:
    """Number of each row's (key, shard) group; equal ones lie together."""
    key, shard = chunk["key"].to_numpy(), chunk["shard"].to_numpy()
    return np.cumsum(np.r_[False, (key[1:] != key[:-1]) | (shard[1:] != shard[:-1])])


def reduced(chunk: pd.DataFrame) -> pd.DataFrame:
    """The undominated versions of each (key, shard) as of the day the next shard begins (``until``)."""
    group = groups_of(chunk)
    valid, recorded, neg, deleted, until = (chunk[c].to_numpy() for c in ("valid", "recorded", "neg", "deleted", "until"))
    order = np.lexsort((-deleted, -neg, -recorded, -valid, group))
    g, v = group[order], np.where(valid <= until, np.iinfo("int32").min, valid)[order]
    first = np.r_[True, (g[1:] != g[:-1]) | (v[1:] != v[:-1])]
    best = pd.Series(deleted[order]).groupby(np.cumsum(first)).cummax().to_numpy()
    kept = first | (deleted[order] > np.r_[0, best[:-1]])
    return chunk.iloc[order[kept]][["key", "shard", "valid", "recorded", "neg", "deleted"]]


def carry_forward(chunk: pd.DataFrame) -> pd.DataFrame:
    """Runs over a hot key's shards in order and hands each shard the undominated versions before it; rows are reduced sets (kind 1) and shard starts (0)."""
    out: list[tuple] = []
    held: list[tuple] = []
    key, shard = None, None
    for k, s, kind, start, day, valid, recorded, neg, deleted in chunk.itertuples(index=False):
        if k != key:
            key, held, shard = k, [], None
        if s != shard:
            shard = s
            held = undominated([v for v in held if v[3] > start], day)
            out += [(k, s, *v) for v in held]
        if kind:
            held.append((valid, recorded, neg, deleted))
    return pd.DataFrame(out, columns=["key", "shard", "valid", "recorded", "neg", "deleted"])


def sweep(chunk: pd.DataFrame) -> pd.DataFrame:
    """Local merge of each (key, shard).

    A group's versions are sorted from the best, so an event starts at its first valid one (binary search) and goes on to
    the next until one was recorded before it and is not deleted; all events of the chunk step together. Groups in which
    that takes more than TRIES steps are swept in order of time.
    """
    group, kind = groups_of(chunk), chunk["kind"].to_numpy()
    of_event, of_version = np.flatnonzero(kind == 0), np.flatnonzero(kind == 1)
    valid, recorded, neg, deleted = (chunk[c].to_numpy()[of_version] for c in ("valid", "recorded", "neg", "deleted"))
    limit = 1 << 23  # day numbers of any date lie within
    order = np.lexsort((-neg, -recorded, -valid, group[of_version]))
    recorded, neg, deleted, owner = recorded[order], neg[order], deleted[order], group[of_version][order]
    ranked = owner * (2 * limit) - np.clip(valid[order], -limit + 1, limit - 1)
    t, asked = chunk["t"].to_numpy()[of_event], group[of_event]
    at = np.searchsorted(ranked, asked * (2 * limit) - np.clip(chunk["day"].to_numpy()[of_event], -limit + 1, limit - 1), "left")
    end = np.searchsorted(owner, asked, "right")
    row = np.zeros(len(of_event), dtype="int64")
    found = np.zeros(len(of_event), dtype=bool)
    open_ = np.flatnonzero(at < end)
    for _ in range(TRIES):
        if not len(open_):
            break
        here = at[open_]
        won = (recorded[here] < t[open_]) & (deleted[here] > t[open_])
        row[open_[won]], found[open_[won]] = -neg[here[won]], True
        open_ = open_[~won]
        at[open_] += 1
        open_ = open_[at[open_] < end[open_]]
    if len(open_):
        late = np.isin(group, asked[open_])
        rest = swept(chunk[late])
        place = of_event[late[of_event]]
        found[late[of_event]] = False
        at_event = pd.Series(np.arange(len(of_event)), index=of_event)
        hit = at_event[place[rest[0]]].to_numpy()
        row[hit], found[hit] = rest[1], True
    return pd.DataFrame({"event_id": chunk["event_id"].to_numpy()[of_event[found]], "row_id": row[found]})


def swept(chunk: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the events (in order) that have a version, and its id: versions enter when recorded, win while valid and not deleted."""
    at, out = [], []
    group, waiting, active, n = None, [], [], -1
    for key, shard, t, kind, day, valid, recorded, neg, deleted, _ in chunk.itertuples(index=False):
        if (key, shard) != group:
            group, waiting, active = (key, shard), [], []
        if kind:
            heapq.heappush(waiting, (valid, -recorded, -neg, deleted))
            continue
        n += 1
        while waiting and waiting[0][0] <= day:
            v, r, i, d = heapq.heappop(waiting)
            heapq.heappush(active, (-v, r, i, d))
        while active and active[0][3] <= t:
            heapq.heappop(active)
        if active:
            at.append(n)
            out.append(active[0][2])
    return np.array(at, dtype=int), np.array(out, dtype="int64")


def bitemporal_asof(events: DataFrame, versions: DataFrame, zone: str = "America/New_York", hot_rows: int = 500_000) -> DataFrame:
    """For each event (event_id, key, t) the version (key, id, valid, recorded, deleted) known and valid at it.

    ``valid`` is a day number, the other times are microseconds. The winner has the latest
    ``valid`` not after the event's date in ``zone``, among versions recorded before the
    event and not deleted at it; ties: latest ``recorded``, then smallest ``id``.
    Returns event_id, row_id.
    """
    days = lambda t: F.unix_date(F.to_date(F.from_utc_timestamp(F.timestamp_micros(t), zone)))
    events = events.where("key is not null and t is not null")
    versions = versions.where("key is not null and valid is not null and recorded is not null").select(
        "key", F.col("recorded").alias("t"), F.col("valid").cast("int").alias("valid"), "recorded", (-F.col("id")).alias("neg"), F.coalesce("deleted", F.lit(NEVER)).alias("deleted")
    )
    shard, bounds = time_shards(events.select("key", "t").unionByName(versions.select("key", "t")), hot_rows)
    right = sharded(versions, shard, bounds)
    left = sharded(events.select("key", "t", "event_id", days(F.col("t")).alias("day")), shard, bounds)
    if bounds is not None:
        slots = bounds.select("key", F.posexplode(F.concat(F.array(F.lit(-(1 << 62))), "bounds")).alias("shard", "start"))
        marks = slots.select("key", "shard", F.lit(0).alias("kind"), "start", F.when(F.col("shard") > 0, days(F.col("start"))).otherwise(F.lit(-(1 << 30))).alias("day"))
        hot = right.join(F.broadcast(bounds), "key").withColumn("until", days(F.get("bounds", F.col("shard")))).where("until is not null").select("key", "shard", "valid", "recorded", "neg", "deleted", "until")
        sets = map_sorted_groups(hot, ["key", "shard"], [], reduced, "key string, shard int, valid int, recorded long, neg long, deleted long").withColumn("kind", F.lit(1))
        each = marks.unionByName(sets, allowMissingColumns=True).select("key", "shard", "kind", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("start", "day", "valid", "recorded", "neg", "deleted")])
        carry = map_sorted_groups(each, ["key"], ["shard", "kind"], carry_forward, "key string, shard int, valid int, recorded long, neg long, deleted long")
        right = right.unionByName(carry.withColumn("t", F.col("recorded")))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    both = left.withColumn("kind", F.lit(0)).unionByName(right.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    both = both.select("key", "shard", "t", "kind", zero("day"), zero("valid"), zero("recorded"), zero("neg"), zero("deleted"), "event_id")
    return map_sorted_groups(both, ["key", "shard"], ["t", "kind"], sweep, "event_id string, row_id long")
