"""Streaming of whole key groups through vectorised Python, in bounded chunks.

``applyInPandas`` calls Python once per group, which is slow with many small groups.
Here a partition is sorted by key and handed on in Arrow chunks that end at a key
boundary, so one vectorised call serves thousands of groups.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def last_boundary(table: pa.Table, keys: Sequence[str]) -> int:
    """Row at which the last key group of a sorted table begins; 0 if it is all one group."""
    n = table.num_rows
    differs = None
    for key in keys:
        column, last = table.column(key), table.column(key)[n - 1]
        if last.as_py() is None:
            d = pc.is_valid(column)
        else:
            d = pc.fill_null(pc.not_equal(column, last), True)
        differs = d if differs is None else pc.or_(differs, d)
    at = pc.max(pc.if_else(differs, pa.array(range(n)), -1)).as_py() if n else -1
    return at + 1


def batches_of(frame: pd.DataFrame, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    if len(frame):
        yield from pa.Table.from_pandas(frame, schema=schema, preserve_index=False).to_batches()


def stream_groups(
    keys: Sequence[str], fn: Callable[[pd.DataFrame], pd.DataFrame], schema: T.StructType, chunk_rows: int
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """An Arrow partition function that feeds ``fn`` chunks of about ``chunk_rows`` rows made of whole groups."""
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows, limit = 0, chunk_rows
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows < limit:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            cut = last_boundary(table, keys)
            if cut:
                yield from batches_of(fn(table.slice(0, cut).to_pandas()), arrow)
                table = table.slice(cut)
            held, rows = table.to_batches(), table.num_rows
            limit = max(chunk_rows, 2 * rows)
        if rows:
            yield from batches_of(fn(pa.Table.from_batches(held).combine_chunks().to_pandas()), arrow)

    return run


def map_sorted_groups(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    fn: Callable[[pd.DataFrame], pd.DataFrame],
    schema: str | T.StructType,
    chunk_rows: int = 65_536,
    clustered: bool = False,
) -> DataFrame:
    """Calls ``fn`` with chunks of whole ``keys`` groups sorted by ``keys`` and ``order``.

    ``fn`` gets and gives pandas frames; a group must fit one chunk, so callers shard
    unbounded groups first. ``clustered``: df is already partitioned by ``keys``.
    Rows with null keys form one group. An empty table gives an empty result.
    """
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    parted = df if clustered else df.repartition(*[F.col(k) for k in keys])
    return parted.sortWithinPartitions(*keys, *order).mapInArrow(stream_groups(list(keys), fn, schema, chunk_rows), schema)


def spread(df: DataFrame) -> DataFrame:
    """Deals the rows of a small scan to all cores before heavy per-row work.

    A table of few files is few tasks; only where there are fewer than cores is it
    repartitioned, so a large table is never shuffled for this.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
