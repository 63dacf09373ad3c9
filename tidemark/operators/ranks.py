"""Exact ranks, quantiles and quantile buckets within groups of any size.

A group of more than ``hot_rows`` rows is cut into shards at approximate quantiles of the
ranked column; each shard is ranked on its own and its rank is lifted by the rows of the
shards before it, so the ranks are exact wherever the cuts lie. Only group sizes, cuts and
shard sizes reach the driver, each of a bounded number.

Defined cases: null keys form a group; null values are left out of quantiles; equal values
of one group are never cut apart; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce
from itertools import accumulate
from operator import add

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.shards import MOST_SHARDS, cut_shards, shard_of

HOT_ROWS = 5_000_000


def with_ranks(df: DataFrame, by: list[str], ranked: dict[str, str | tuple[str, str]], hot_rows: int = HOT_ROWS, most: int = MOST_SHARDS) -> DataFrame:
    """Adds ``_n`` (rows of the group) and, per name, ranks from 1 of a column: ``<name>_low`` and ``<name>_high`` (first and
    last rank of equal values), or for (column, tie column) the row number ``<name>_row``."""
    spark = df.sparkSession
    key = F.to_json(F.struct(*by), {"ignoreNullFields": "false"}) if by else F.lit("")
    counted = df.groupBy(key.alias("__key")).agg(F.count(F.lit(1)).alias("_n"))
    seen = counted.orderBy(F.desc("_n"), "__key").limit(most + 1).collect()
    sizes = F.broadcast(spark.createDataFrame([tuple(r) for r in seen], "__key string, _n long")) if len(seen) <= most else counted
    out = df.withColumn("__key", key).join(sizes, "__key")
    hot = {r["__key"]: r["_n"] for r in seen[:most] if r["_n"] > hot_rows}
    for name, what in ranked.items():
        column, tie = (what, None) if isinstance(what, str) else what
        before, parts = F.lit(0), list(by)
        bounds = cut_shards(df.select(key.alias("key"), F.col(column).alias("t")), hot, hot_rows, most) if hot else None
        if bounds is not None:
            bounds = bounds.toDF("__key", "__bounds")
            out = out.join(F.broadcast(bounds), "__key", "left").withColumn("__shard", shard_of(column, "__bounds")).drop("__bounds")
            lifted = [(k, s, n) for k, found in shard_sizes(out, bounds).items() for s, n in zip(found, accumulate(found.values(), initial=0))]
            out = out.join(F.broadcast(spark.createDataFrame(lifted, "__key string, __shard int, __before long")), ["__key", "__shard"], "left")
            before, parts = F.coalesce("__before", F.lit(0)), [*by, "__shard"]
        inside = Window.partitionBy(*parts)
        if tie:
            out = out.withColumn(f"{name}_row", F.row_number().over(inside.orderBy(column, tie)) + before)
        else:
            low = F.rank().over(inside.orderBy(column)) + before
            out = out.withColumn(f"{name}_low", low).withColumn(f"{name}_high", F.col(f"{name}_low") + F.count(F.lit(1)).over(Window.partitionBy(*parts, column)) - 1)
        out = out.drop("__shard", "__before")
    return out.drop("__key")


def shard_sizes(rows: DataFrame, bounds: DataFrame) -> dict[str, dict[int, int]]:
    """Rows of each shard of the cut keys, in order. At most twice the bounded number of cuts."""
    found: dict[str, dict[int, int]] = {}
    for r in rows.join(F.broadcast(bounds.select("__key")), "__key", "left_semi").groupBy("__key", "__shard").count().orderBy("__key", "__shard").collect():
        found.setdefault(r["__key"], {})[r["__shard"]] = r["count"]
    return found


def exact_quantiles(df: DataFrame, by: list[str], column: str, at: list[float], out: str = "quantiles", hot_rows: int = HOT_ROWS) -> DataFrame:
    """by and the list of linearly interpolated quantiles of the values that are not null."""
    rows = with_ranks(df.where(F.col(column).isNotNull()).select(*by, column), by, {"_q": column}, hot_rows)
    n = F.col("_n")
    value = lambda k: F.min(F.when(F.col("_q_high") > k, F.col(column)))
    picks = [c.alias(f"{side}{i}") for i, q in enumerate(at) for side, c in (("a", value(F.floor((n - 1) * q))), ("b", value(F.floor((n - 1) * q) + 1)))]
    got = rows.groupBy(*by).agg(F.max("_n").alias("_n"), *picks)

    def between(i: int, q: float) -> Column:
        a, place = F.col(f"a{i}"), (n - 1) * q
        return a + (F.coalesce(f"b{i}", a) - a) * (place - F.floor(place))

    return got.select(*by, F.array(*[between(i, q) for i, q in enumerate(at)]).alias(out))


def bucketed(df: DataFrame, by: list[str], column: str, tie: str, n: int, out: str = "bucket", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Adds the bucket 1..n of a row's rank by (column, tie) within ``by``: 1 and the number of cut points below the rank.

    Cut points are the linear quantiles of the ranks at the even shares of n, in the usual double arithmetic, so that ranks on a cut
    fall as they do in common libraries. Null for a group of one row.
    """
    rows = with_ranks(df, by, {"_b": (column, tie)}, hot_rows)
    rank, total = F.col("_b_row"), F.col("_n")

    def below(share: float) -> Column:
        place = (total - 1) * F.lit(share)
        whole = F.floor(place)
        part = place - whole
        cut = F.when(part < 0.5, (whole + 1) + part).otherwise((whole + 2) - (1 - part))
        return (cut < rank).cast("int")

    shares = (np.linspace(0, 1, n + 1) * 100.0 / 100)[1:-1].tolist()
    over = reduce(add, map(below, shares), F.lit(1))
    return rows.withColumn(out, F.when(total > 1, over.cast("int"))).drop("_b_row", "_n")
