"""Implausible spikes in measurements, judged against each source's own moves.

Bars are first reduced to one row per source and day (combined before the shuffle), so a
day with very many copies or versions is one row. Pass 1 runs over (source, block of
days) shards of these with replicated edges. For each field it
measures how far a reading leaves the level on both sides of an excursion of at most
three readings, finds runs of equal readings (zero variance), and sketches the source's
usual relative moves: a mergeable quantile sketch with logarithmic bins per context
(hour of the reading). Pass 2 merges a source's sketches and keeps the excursions
beyond the expanded interquartile fence of their context. Copies of a reading are
collapsed before pass 1 and found again by a join at the end.

Defined cases: null readings are no readings; values that are not above zero (prices) or
below zero (counts) are flagged as impossible and take no part in levels; of several
readings of one source and day the latest (stamp) stands for the day, and each other
one is judged in its place; a source with fewer than ``least`` moves has no fence, so
only impossible and stuck values are flagged; a neighbour further than ``edge_days``
away is no neighbour; a row without a day or with a null in a source column belongs to no
source and is only held against the impossible values; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.grouped import map_sorted_groups

SKETCH_GAIN = 1.05
SKETCH_LEAST = 1e-5


@dataclass(frozen=True)
class Field:
    """How a measured column is judged.

    ``fence``: multiples of the usual move (interquartile range as a standard deviation)
    an excursion must exceed; ``factor``: the least ratio to the level that counts;
    ``level``: readings on each side whose median is the level; ``zero_ok``: 0 is possible.
    """

    name: str
    fence: float
    factor: float = 1.0
    level: int = 1
    zero_ok: bool = False


def shifted(x: np.ndarray, group: np.ndarray, by: int) -> np.ndarray:
    """x of the row ``by`` rows later (earlier if negative) in the same group, else nan."""
    out = np.full(len(x), np.nan)
    if abs(by) < len(x):
        src, dst = (slice(by, None), slice(None, -by)) if by > 0 else (slice(None, by), slice(-by, None))
        same = group[src] == group[dst]
        out[dst] = np.where(same, x[src], np.nan)
    return out


def neighbours(x: np.ndarray, group: np.ndarray, day: np.ndarray, steps: list[int], edge: int) -> np.ndarray:
    """Median of the readings that many rows away (negative: earlier), within ``edge`` days."""
    seen = []
    for k in steps:
        v, d = shifted(x, group, k), shifted(day, group, k)
        seen.append(np.where(np.abs(d - day) <= edge, v, np.nan))
    if len(steps) == 1:
        return seen[0]
    rows = np.sort(np.column_stack(seen), axis=1)  # nan goes last
    n, i = len(steps) - np.isnan(rows).sum(axis=1), np.arange(len(rows))
    return np.where(n > 0, (rows[i, np.maximum(n - 1, 0) // 2] + rows[i, np.minimum(n // 2, len(steps) - 1)]) / 2, np.nan)


def levels(x: np.ndarray, group: np.ndarray, day: np.ndarray, start: int, width: int, side: int, edge: int) -> np.ndarray:
    """Median of the ``width`` readings from ``start`` rows away on one side."""
    return neighbours(x, group, day, [side * k for k in range(start, start + width)], edge)


def surroundings(x: np.ndarray, group: np.ndarray, day: np.ndarray, edge: int, reach: int = 5) -> np.ndarray:
    """Median of the readings on both sides; a normal reading between two excursions lies near it."""
    return neighbours(x, group, day, [k for k in range(-reach, reach + 1) if k], edge)


def excursions(x: np.ndarray, group: np.ndarray, day: np.ndarray, f: Field, edge: int, longest: int = 3, home: float = 0.5) -> np.ndarray:
    """Least distance to the level before and after, for readings of an excursion that comes back; else 0."""
    best = np.zeros(len(x))
    before, around = levels(x, group, day, 1, f.level, -1, edge), surroundings(x, group, day, edge)
    for m in range(1, longest + 1):
        pre, post = before, levels(x, group, day, m, f.level, 1, edge)  # an excursion that begins here
        size = np.full(len(x), np.inf)
        for j in range(m):
            v = shifted(x, group, j) if j else x
            up, down = v - pre, v - post
            size = np.minimum(size, np.where(up * down > 0, np.minimum(np.abs(up), np.abs(down)), 0.0))
            out = (v - (shifted(around, group, j) if j else around)) * np.sign(up)
            size = np.where(out > home * size, size, 0.0)
        lead = np.sign(x - pre)
        for j in range(1, m):
            size = np.where(np.sign(shifted(x, group, j) - pre) == lead, size, 0.0)
        size = np.where(np.isfinite(size) & (np.abs(post - pre) < home * size), size, 0.0)
        for j in range(m):
            moved = np.nan_to_num(shifted(size, group, -j)) if j else size
            best = np.maximum(best, moved)
    return best


def stuck_rows(value: np.ndarray, live: np.ndarray, group: np.ndarray, more_than: int) -> np.ndarray:
    """Repetitions after the first in runs of more than ``more_than`` equal successive readings of a live source."""
    fresh = np.r_[True, (value[1:] != value[:-1]) | (group[1:] != group[:-1])]
    run = np.cumsum(fresh) - 1
    size = np.bincount(run)
    alive = np.bincount(run, weights=live.astype(float))
    return ~fresh & ((size > more_than) & (alive > size / 2))[run]


def bins_of(moves: np.ndarray) -> np.ndarray:
    """Signed logarithmic bin of each move; 0 for moves below the least."""
    size = np.abs(moves)
    at = np.ceil(np.log(np.maximum(size, SKETCH_LEAST) / SKETCH_LEAST) / np.log(SKETCH_GAIN)).astype("int64")
    return np.sign(moves).astype("int64") * at


def value_of(bins: np.ndarray) -> np.ndarray:
    return np.sign(bins) * SKETCH_LEAST * SKETCH_GAIN ** (np.abs(bins) - 0.5) * (bins != 0)


def inspect(chunk: pd.DataFrame, keys: list[str], fields: list[Field], edge: int, stuck: int) -> pd.DataFrame:
    """Pass 1 over whole (source, block) groups, one row per day: sketches (kind 0), excursions (1), stuck
    readings (2), and the levels around each day that has other readings than the one that stands for it (3)."""
    group = chunk.groupby([*keys, "block"], dropna=False, sort=False).ngroup().to_numpy()
    day = chunk["day"].to_numpy().astype(float)
    core, context = chunk["core"].to_numpy(), chunk["context"].to_numpy()
    live = chunk["live"].to_numpy(dtype=float) > 0
    out = []

    def emit(rows: np.ndarray, name: str, kind: int, value: np.ndarray | float, size: np.ndarray | float = 0.0, **more) -> None:
        if len(rows):
            part = {k: chunk[k].to_numpy()[rows] for k in keys}
            out.append(pd.DataFrame(part | {"field": name, "context": context[rows], "kind": kind, "day": chunk["day"].to_numpy()[rows], "value": value, "size": size, "bins": None, "counts": None, "levels": None} | more))

    for i, f in enumerate(fields):
        usable, raw = chunk[f"usable_{i}"].to_numpy(dtype=float), chunk[f"latest_{i}"].to_numpy(dtype=float)
        at = np.flatnonzero(np.isfinite(usable))
        if len(at):
            x, g, d = np.log(usable[at]), group[at], day[at]
            mine = core[at]
            size = excursions(x, g, d, f, edge)
            hit = (size > max(np.log(f.factor), SKETCH_LEAST)) & mine
            emit(at[hit], f.name, 1, usable[at[hit]], size[hit])
            before = levels(x, g, d, 1, f.level, -1, edge)
            other = chunk["other"].to_numpy()[at] & mine
            if other.any():
                # next to an excursion the level is a median, next to a lasting move the nearest readings
                wide = max(f.level, 5)
                sides = [before, levels(x, g, d, 1, f.level, 1, edge), levels(x, g, d, 1, wide, -1, edge), levels(x, g, d, 1, wide, 1, edge), surroundings(x, g, d, edge)]
                emit(at[other], f.name, 3, usable[at[other]], levels=list(np.column_stack(sides)[other]))
            moves = x - before
            use = np.isfinite(moves) & mine
            if use.any():
                sketch = pd.DataFrame({"g": g[use], "c": context[at[use]], "b": bins_of(moves[use]), "i": at[use]}).groupby(["g", "c", "b"])["i"].agg(["min", "size"]).reset_index()
                turn = np.flatnonzero((np.diff(sketch["g"]) != 0) | (np.diff(sketch["c"]) != 0)) + 1
                first = sketch["min"].to_numpy()[np.r_[0, turn]]
                emit(first, f.name, 0, np.nan, bins=np.split(sketch["b"].to_numpy(), turn), counts=np.split(sketch["size"].to_numpy(), turn))
        held = np.flatnonzero(np.isfinite(raw))
        if len(held):
            still = held[stuck_rows(raw[held], live[held], group[held], stuck) & core[held]]
            emit(still, f.name, 2, raw[still])
    columns = [*keys, "field", "context", "kind", "day", "value", "size", "bins", "counts", "levels"]
    return pd.concat(out)[columns] if out else pd.DataFrame(columns=columns)


def fence(chunk: pd.DataFrame, keys: list[str], fences: dict[str, tuple[float, float]], least: int) -> pd.DataFrame:
    """Pass 2 over whole (source, field, context) groups: merges the sketches, keeps excursions beyond the fence and gives days with other readings their bound."""
    group = chunk.groupby([*keys, "field", "context"], dropna=False, sort=False).ngroup().to_numpy()
    kind = chunk["kind"].to_numpy()
    n = group.max() + 1 if len(group) else 0
    bins, counts = chunk["bins"].to_numpy()[kind == 0], chunk["counts"].to_numpy()[kind == 0]
    sizes = list(map(len, bins))
    flat = {"g": np.repeat(group[kind == 0], sizes), "bin": np.concatenate([*bins, []]).astype("int64"), "size": np.concatenate([*counts, []])}
    sketch = pd.DataFrame(flat).groupby(["g", "bin"])["size"].sum().reset_index()
    g, count = sketch["g"].to_numpy(), sketch["size"].to_numpy()
    total = np.bincount(g, weights=count, minlength=n)
    running = np.cumsum(count) - np.r_[0, np.cumsum(total)][g]
    centre = value_of(sketch["bin"].to_numpy())
    quartile = {}
    for q in (0.25, 0.75):
        reached = running >= q * total[g]
        first = np.flatnonzero(reached & np.r_[True, (g[1:] != g[:-1]) | ~reached[:-1]]) if len(g) else np.array([], dtype=int)
        quartile[q] = np.full(n, np.nan)
        quartile[q][g[first]] = centre[first]
    sigma = (quartile[0.75] - quartile[0.25]) / 1.349
    bound = np.maximum(chunk["field"].map({k: v[0] for k, v in fences.items()}).to_numpy(dtype=float) * sigma[group], chunk["field"].map({k: v[1] for k, v in fences.items()}).to_numpy(dtype=float)) if n else sigma
    fenced = (total[group] >= least) & (sigma[group] > 0) if n else np.array([], dtype=bool)
    kept = (kind == 2) | (fenced & (kind == 1) & (chunk["size"].to_numpy(dtype=float) > bound)) | (fenced & (kind == 3))
    return chunk.assign(bound=bound).loc[kept, [*keys, "field", "kind", "day", "value", "levels", "bound"]]


def out_of_place(value: Column, levels: Column, bound: Column) -> Column:
    """Whether a reading in the place of a day's usual one would be an excursion of its own."""
    x = F.ln(F.when(value > 0, value))
    level = lambda i: F.nanvl(F.get(levels, F.lit(i)), F.lit(None).cast("double"))
    around = level(4)

    def beyond(pre: Column, post: Column) -> Column:
        up, down = x - pre, x - post
        far = F.least(F.abs(up), F.abs(down))
        return (up * down > 0) & (far > bound) & (F.abs(post - pre) < 0.5 * far) & ((x - around) * F.signum(up) > 0.5 * far)

    return F.coalesce(beyond(level(0), level(1)), F.lit(False)) | F.coalesce(beyond(level(2), level(3)), F.lit(False))


def find_spikes(
    bars: DataFrame, keys: list[str], row_id: str, day: str, stamp: str, activity: str, fields: list[Field], stuck: int = 5, least: int = 8, block_days: int = 768, edge_days: int = 120, context=None
) -> DataFrame:
    """Flagged readings, one row per row id and field: row id, field_name.

    ``activity``: the column that is above 0 while the source trades; ``context``: a
    column expression that buckets the fences (the hour of ``day`` if it is a timestamp,
    one bucket for dates). ``edge_days`` reaches further than any excursion or run it takes to judge a row.
    """
    names = [f.name for f in fields]
    types = dict(bars.dtypes)
    if context is None and types[day] == "timestamp":
        context = F.hour(day)
    # one row per source and day, reduced before the shuffle: the latest bar, the latest usable reading of each field, the number of bars
    extra = {} if activity in names else {"live": F.col(activity)}
    extra |= {} if context is None else {"context": context.cast("int")}
    latest = F.max(F.struct(F.col(stamp).alias("stamp"), *[F.col(n).alias(f"v{i}") for i, n in enumerate(names)], *[c.alias(n) for n, c in extra.items()])).alias("latest")
    usable = [F.max(F.when(F.col(n) > 0, F.struct(F.col(stamp).alias("stamp"), F.col(n).alias("v")))).alias(f"u{i}") for i, n in enumerate(names)]
    daily = bars.dropna(subset=[day, *keys]).groupBy(*keys, F.unix_date(F.to_date(day)).alias("day")).agg(latest, *usable, F.count(F.lit(1)).alias("n"))
    live = F.col("latest.live" if "live" in extra else f"latest.v{names.index(activity)}").alias("live")
    values = [c for i in range(len(names)) for c in (F.col(f"latest.v{i}").alias(f"latest_{i}"), F.col(f"u{i}.v").alias(f"usable_{i}"))]
    daily = daily.select(*keys, "day", live, (F.col("latest.context") if context is not None else F.lit(0)).alias("context"), (F.col("n") > 1).alias("other"), *values)
    blocks = F.sequence(F.floor((F.col("day") - edge_days) / block_days), F.floor((F.col("day") + edge_days) / block_days))
    placed = daily.withColumn("block", F.explode(blocks)).withColumn("core", F.col("block") == F.floor(F.col("day") / block_days))
    heads = ", ".join(f"`{k}` {types[k]}" for k in keys)
    schema = heads + ", field string, context int, kind int, day int, value double, size double, bins array<int>, counts array<int>, levels array<double>"
    first = map_sorted_groups(placed, [*keys, "block"], ["day"], lambda c: inspect(c, keys, fields, edge_days, stuck), schema)
    fences = {f.name: (f.fence, max(float(np.log(f.factor)), SKETCH_LEAST)) for f in fields}
    schema = heads + ", field string, kind int, day int, value double, levels array<double>, bound double"
    flagged = map_sorted_groups(first, [*keys, "field", "context"], ["kind"], lambda c: fence(c, keys, fences, least), schema)
    pick = lambda n, c, *kinds: F.when((F.col("field") == n) & F.col("kind").isin(*kinds), F.col(c))
    parts = [p for i, n in enumerate(names) for p in (F.collect_set(pick(n, "value", 1, 2)).alias(f"bad_{i}"), F.max(pick(n, "value", 3)).alias(f"stands_{i}"), F.max(pick(n, "levels", 3)).alias(f"levels_{i}"), F.max(pick(n, "bound", 3)).alias(f"bound_{i}"))]
    wide = flagged.groupBy(*keys, "day").agg(*parts).alias("w")
    sides = bars.select(*keys, row_id, F.unix_date(F.to_date(day)).alias("day"), *[F.col(n).alias(f"v{i}") for i, n in enumerate(names)]).alias("b")
    met = sides.join(wide, [F.col(f"b.{k}") == F.col(f"w.{k}") for k in [*keys, "day"]], "left")

    def wrong(i: int, f: Field) -> Column:
        v = F.col(f"v{i}")
        impossible = v < 0 if f.zero_ok else v <= 0
        other = (v != F.col(f"stands_{i}")) & out_of_place(v, F.col(f"levels_{i}"), F.col(f"bound_{i}"))
        return F.coalesce(impossible, F.lit(False)) | F.coalesce(F.array_contains(f"bad_{i}", v), F.lit(False)) | F.coalesce(other, F.lit(False))

    cases = F.array_compact(F.array(*[F.when(wrong(i, f), F.lit(f.name)) for i, f in enumerate(fields)]))
    return met.select(F.col(f"b.{row_id}").alias(row_id), F.explode(cases).alias("field_name"))
