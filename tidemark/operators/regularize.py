"""Irregular readings onto a regular grid, with gaps imputed by iterative singular-spectrum analysis.

Readings are collapsed to one per source and slot, cut into buckets of ``bucket`` slots
(so a long source is many independent pieces of work), and each bucket is filled up to
the next bucket's first reading. A segment with gaps starts from straight lines across
them; then its Hankel trajectory matrix is truncated to the leading singular vectors and
the missing entries are replaced by the reconstruction until they settle: until no entry
moves by more than ``tolerance`` of the segment's range. ``rounds`` only guards against a
segment that never does; asked for with ``flag``, such a segment's rows are marked.

Defined cases: a null value is no reading; of several readings of one slot the latest
(stamp, then id) counts; a source with one reading has no gaps; a segment shorter than
two windows keeps its straight lines; null source columns form a source of their own; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

CONTEXT = 48


def ssa_fill(values: np.ndarray, missing: np.ndarray, window: int, rank: int, rounds: int, tolerance: float) -> np.ndarray:
    """``values`` with its ``missing`` entries (already some first guess) replaced by the low-rank reconstruction."""
    return ssa_settle(values, missing, window, rank, rounds, tolerance)[0]


def ssa_settle(values: np.ndarray, missing: np.ndarray, window: int, rank: int, rounds: int, tolerance: float) -> tuple[np.ndarray, bool]:
    """As ``ssa_fill``, and whether the entries settled within ``rounds``."""
    n = len(values)
    window = min(window, n // 2)
    if window < 2 or not missing.any():
        return values, True
    centre = values[~missing].mean()
    x = values - centre
    scale = np.abs(x).max() or 1.0
    k = n - window + 1
    weight = np.minimum(np.minimum(np.arange(1, n + 1), np.arange(n, 0, -1)), min(window, k)).astype(float)
    for _ in range(rounds):
        hankel = np.lib.stride_tricks.sliding_window_view(x, k)
        vectors = np.linalg.eigh(hankel @ hankel.T)[1][:, -rank:]
        scores = vectors.T @ hankel
        smooth = sum(np.convolve(scores[i], vectors[:, i]) for i in range(vectors.shape[1])) / weight
        change = np.abs(smooth[missing] - x[missing]).max()
        x[missing] = smooth[missing]
        if change <= tolerance * scale:
            return x + centre, True
    return x + centre, False


def fill_segments(keys: list[str], schema: T.StructType, window: int, rank: int, rounds: int, tolerance: float):
    """A column of ``schema`` after the keys, slot, value and filled says whether the row's segment settled."""
    arrow = to_arrow_schema(schema)
    flagged = len(schema) > len(keys) + 3

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(k, 512) for whole in batches for k in range(0, whole.num_rows, 512)):
            rows, slots, values, filled, settled = [], [], [], [], []
            points = batch.column("points")
            ahead, behind = batch.column("ahead"), batch.column("behind")
            own = list_pairs(points), list_pairs(behind), list_pairs(ahead)
            for i in range(batch.num_rows):
                (at, val), (b_at, b_val), (a_at, a_val) = (side[i] for side in own)
                end = a_at[0] if len(a_at) else at[-1] + 1
                ords, vals = np.concatenate([b_at, at, a_at]), np.concatenate([b_val, val, a_val])
                first = ords[0]
                grid = np.arange(first, ords[-1] + 1)
                gap = np.ones(len(grid), dtype=bool)
                gap[ords - first] = False
                full = np.interp(grid, ords, vals)
                mine = slice(at[0] - first, end - first)
                done = True
                if gap[mine].any():
                    full, done = ssa_settle(full, gap, window, rank, rounds, tolerance)
                rows.append(np.full(end - at[0], i))
                slots.append(grid[mine])
                values.append(full[mine])
                filled.append(gap[mine])
                settled.append(np.full(end - at[0], done))
            if rows:
                index = pa.array(np.concatenate(rows))
                columns = [batch.column(k).take(index) for k in keys]
                columns += [pa.array(np.concatenate(slots), pa.int32()), pa.array(np.concatenate(values)), pa.array(np.concatenate(filled))]
                if flagged:
                    columns.append(pa.array(np.concatenate(settled)))
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return run


def list_pairs(column: pa.ListArray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The (slots, values) of each row of a list of structs; empty for null."""
    flat = column.flatten()
    at, val = flat.field("at").to_numpy(zero_copy_only=False), flat.field("value").to_numpy(zero_copy_only=False)
    sizes = np.array([0 if n is None else n for n in column.value_lengths().to_pylist()], dtype=int)
    ends = np.cumsum(sizes)
    return [(at[e - s : e], val[e - s : e]) for s, e in zip(sizes, ends)]


def latest_reading(df: DataFrame, keys: list[str], slot: str, values: list[str], rank: list[str]) -> DataFrame:
    """One row per source and slot: the reading with the greatest ``rank`` columns. Combined before the shuffle."""
    best = F.max(F.struct(*rank, *values)).alias("best")
    return df.groupBy(*keys, slot).agg(best).select(*keys, slot, *[F.col(f"best.{v}").alias(v) for v in values])


def regularize(
    readings: DataFrame, keys: list[str], slot: str, value: str, rank: list[str], window: int = 16, components: int = 3, bucket: int = 512, rounds: int = 5000, tolerance: float = 1e-3, flag: str | None = None
) -> DataFrame:
    """One row per source and slot between its first and last reading: ``keys``, slot, value, filled.

    ``slot`` is the integer position on the grid. ``flag`` names a further column: false in the segments that ``rounds`` stopped.
    """
    real = readings.where(F.col(value).isNotNull() & F.col(slot).isNotNull())
    points = latest_reading(real, keys, slot, [value], rank).withColumn("bucket", F.floor(F.col(slot) / bucket))
    point = F.struct(F.col(slot).cast("int").alias("at"), F.col(value).cast("double").alias("value"))
    buckets = points.groupBy(*keys, "bucket").agg(F.sort_array(F.collect_list(point)).alias("points"))
    order = Window.partitionBy(*keys).orderBy("bucket")
    head, tail = F.slice("points", 1, CONTEXT), F.slice("points", F.greatest(F.lit(1), F.size("points") - CONTEXT + 1), CONTEXT)
    placed = buckets.withColumns({"behind": F.lag(tail).over(order), "ahead": F.lead(head).over(order)})
    types = dict((f.name, f.dataType) for f in readings.schema.fields)
    schema = T.StructType([T.StructField(k, types[k]) for k in keys] + [T.StructField(slot, T.IntegerType()), T.StructField(value, T.DoubleType()), T.StructField("filled", T.BooleanType())])
    if flag:
        schema.add(flag, T.BooleanType())
    return placed.select(*keys, "points", "behind", "ahead").mapInArrow(fill_segments(keys, schema, window, components, rounds, tolerance), schema)


def session_of(df: DataFrame, day: str, sessions: DataFrame, out: str) -> DataFrame:
    """Adds the ordinal of the last session not after ``day``; rows before the first session are left out.

    ``sessions`` (session_date, ord) is an exchange calendar: about 252 rows a year, so its days are broadcast.
    """
    after = F.lead("session_date").over(Window.orderBy("session_date"))
    days = sessions.withColumn("until", F.coalesce(F.date_sub(after, 1), F.col("session_date"))).select(F.explode(F.sequence("session_date", "until")).alias("__day"), F.col("ord").alias("__ord"))
    last = sessions.agg(F.max(F.struct("session_date", "ord")).alias("x")).select("x.*").first()
    if last is None or last["session_date"] is None:
        return df.withColumn(out, F.lit(None).cast("int")).where("false")
    joined = df.join(F.broadcast(days), F.col(day) == F.col("__day"), "left")
    return joined.withColumn(out, F.coalesce("__ord", F.when(F.col(day) > F.lit(last["session_date"]), F.lit(last["ord"])))).where(F.col(out).isNotNull()).drop("__day", "__ord")
