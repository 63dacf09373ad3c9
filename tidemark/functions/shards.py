"""Cutting hot keys into shards of bounded size along an order, with bounded tables on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hot keys, and shards of hot keys beyond the first of each, at most; a key left whole has at most that part of all rows.
MOST_SHARDS = 10_000


def cut_shards(rows: DataFrame, hot: dict[str, int], hot_rows: int, most: int = MOST_SHARDS) -> DataFrame | None:
    """The bounds of each key's shards, at quantiles of ``t``: (key, bounds); None if no key has enough rows.

    ``hot``: rows of the keys with more than ``hot_rows``, at most ``most`` keys. With more rows than ``most`` times
    ``hot_rows`` in all a shard holds more than ``hot_rows``, so there are at most ``most`` bounds.
    """
    each = max(hot_rows, -(-sum(hot.values()) // most))
    shards = {k: -(-n // each) for k, n in hot.items() if n > each}
    if not shards:
        return None
    spark = rows.sparkSession
    top = max(shards.values())
    keys = spark.createDataFrame(list(shards.items()), "key string, shards int")
    cuts = [i / top for i in range(1, top)]
    bounds = rows.join(F.broadcast(keys), "key").groupBy("key", "shards").agg(F.percentile_approx("t", F.lit(cuts), 10 * top).alias("q"))
    pick = F.transform(F.sequence(F.lit(1), F.col("shards") - 1), lambda i: F.element_at("q", F.greatest(F.lit(1), F.floor(i * top / F.col("shards")).cast("int"))))
    found = [(r["key"], sorted(set(r["b"]))) for r in bounds.select("key", pick.alias("b")).collect()]
    return spark.createDataFrame(found, f"key string, bounds array<{dict(rows.dtypes)['t']}>")


def time_shards(rows: DataFrame, hot_rows: int, most: int = MOST_SHARDS) -> tuple[Column, DataFrame | None]:
    """Shard number of a row (columns ``key``, ``t``) and the hot keys' bounds; bounds is None if no key is hot."""
    counted = rows.where("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot_rows)
    hot = {r["key"]: r["n"] for r in counted.orderBy(F.desc("n"), "key").limit(most).collect()}
    bounds = cut_shards(rows, hot, hot_rows, most) if hot else None
    return (shard_of("t"), bounds) if bounds is not None else (F.lit(0), None)


def shard_of(column: str, bounds: str = "bounds") -> Column:
    """Number of bounds not above a row's value."""
    return F.coalesce(F.size(F.filter(bounds, lambda b: b <= F.col(column))), F.lit(0))


def sharded(df: DataFrame, shard: Column, bounds: DataFrame | None) -> DataFrame:
    if bounds is None:
        return df.withColumn("shard", F.lit(0))
    return df.join(F.broadcast(bounds), "key", "left").withColumn("shard", shard).drop("bounds")
