"""Structured Streaming twins of the batch operators: windowed activity, sessions, late data, spike state.

In ``append`` mode a window or session comes out once, when the watermark has passed it, and
its state is dropped then; so state is bounded by the windows open at a time. Rows behind the
watermark are late: Spark drops them.

Defined cases: rows with a null stamp are left out; rows later than the watermark are
dropped by Spark; an empty stream gives nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_folder(spark: SparkSession, folder: str, pattern: str, schema, files_per_trigger: int = 100) -> DataFrame:
    """A stream over the parquet files of a folder whose names match ``pattern``."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def windowed_activity(stream: DataFrame, stamp: str, key: str, value: str, size: str, slide: str | None = None, late: str = "1 day") -> DataFrame:
    """Count and total per key and time window (tumbling, or sliding with ``slide``), final once the watermark passes."""
    span = F.window(stamp, size, slide) if slide else F.window(stamp, size)
    seen = stream.where(F.col(stamp).isNotNull()).withWatermark(stamp, late)
    return seen.groupBy(span.alias("span"), key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("span.start").alias("start"), F.col("span.end").alias("end"), key, "n", "total")


def sessions(stream: DataFrame, stamp: str, key: str, gap: str, late: str = "1 day") -> DataFrame:
    """Activity sessions per key: start, end, n."""
    seen = stream.where(F.col(stamp).isNotNull()).withWatermark(stamp, late)
    return seen.groupBy(F.session_window(stamp, gap).alias("span"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("span.start").alias("start"), F.col("span.end").alias("end"), key, "n")


def first_delivery(stream: DataFrame, stamp: str, keys: list[str], late: str = "1 day") -> DataFrame:
    """Drops redelivered rows (equal ``keys``) that come within the watermark."""
    return stream.withWatermark(stamp, late).dropDuplicatesWithinWatermark(keys)


def running_surprise(stream: DataFrame, key: str, value: str, order: list[str] | None = None) -> DataFrame:
    """Each reading against its key's readings so far: key, n, value, mean and deviation of the earlier ones.

    The state per key is three numbers, whatever its history. Readings of a micro-batch are taken in ``order`` (nulls
    last; else as they arrive), those of earlier ones before them. A key's rows of one micro-batch are held together.
    """
    kind = dict(stream.dtypes)[key]
    order = order or []

    def update(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, mean, squares = state.get if state.exists else (0, 0.0, 0.0)
        rows = pd.concat(list(parts))
        if order:
            rows = rows.sort_values(order, kind="stable")
        x = rows[value].to_numpy(dtype=float)
        x = x[~np.isnan(x)]
        if not len(x):
            return
        centre = mean if n else x[0]
        far = x - centre
        # sums over the readings before each one, and after the last
        before, count = np.cumsum(np.r_[0.0, far]), n + np.arange(len(x) + 1)
        spread = squares + np.cumsum(np.r_[0.0, far * far]) - before * before / np.maximum(count, 1)
        means = centre + before / np.maximum(count, 1)
        state.update((int(count[-1]), float(means[-1]), float(max(0.0, spread[-1]))))
        count, means, spread = count[:-1], means[:-1], np.maximum(spread[:-1], 0.0)
        yield pd.DataFrame({key: k[0], "n": count, value: x, "mean": np.where(count > 0, means, np.nan), "deviation": np.where(count > 1, np.sqrt(spread / np.maximum(count - 1, 1)), np.nan)})

    schema = f"`{key}` {kind}, n long, `{value}` double, mean double, deviation double"
    told = stream.select(*dict.fromkeys([key, value, *order]))
    return told.groupBy(key).applyInPandasWithState(update, schema, "n long, mean double, squares double", "append", GroupStateTimeout.NoTimeout)


def run_available(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there now, writes its result under a shared folder and returns it.

    ``complete`` and ``update`` results replace those of the batch before. Nothing is collected to the driver. The
    stream's state is removed after the run; the result stays as a table in ``folder``.
    """
    out, state = f"{folder}/out", f"{folder}/state"

    def write(batch: DataFrame, number: int) -> None:
        # a batch that is run again overwrites its own rows
        batch.write.mode("overwrite").parquet(out if mode == "complete" else f"{out}/batch={number}")

    query = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    remove(stream.sparkSession, state)
    return stream.sparkSession.read.schema(stream.schema).parquet(out).select(*stream.columns)


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder on whatever file system it lies."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
