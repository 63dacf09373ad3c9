"""Rolling totals over trailing periods of days, days without activity included.

Rows are reduced to sparse daily totals, calendar rows are generated for every day of a
source's life, and a range frame over integer day numbers sums what falls in it. A
source's life is cut into shards of ``shard_days``; the days that still reach into the
next shard are replicated to it, so each shard's frames are complete and a source that
holds a third of all rows is many tasks. Averages divide by the fixed number of days.

Defined cases: a row without a day is left out; null or negative amounts count as 0 in
totals; null source columns form a source of their own; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def rolling_totals(daily: DataFrame, keys: list[str], day: str, amounts: list[str], periods: list[int], shard_days: int = 512) -> DataFrame:
    """One row per source and day from its first to its last: ``keys``, day_no, first_day and, per amount and period p, total_<amount>_<p> and mean_<amount>_<p>.

    ``daily`` may hold several rows of a day; their amounts add up. ``day`` is a date.
    """
    reach = max(periods) - 1
    shard_days = max(shard_days, reach + 1)
    no = F.unix_date(day)
    amount = [F.sum(F.greatest(F.coalesce(F.col(a), F.lit(0.0)), F.lit(0.0))).alias(a) for a in amounts]
    sparse = daily.where(F.col(day).isNotNull()).groupBy(*keys, no.alias("day_no")).agg(*amount)
    lives = daily.where(F.col(day).isNotNull()).groupBy(*keys).agg(F.min(no).alias("first_day"), F.max(no).alias("last_day"))
    shard = lambda c: F.floor(F.col(c) / shard_days).cast("int")
    lives = lives.withColumn("shard", F.explode(F.sequence(shard("first_day"), shard("last_day"))))
    from_, to = F.greatest("first_day", F.col("shard") * shard_days), F.least("last_day", F.col("shard") * shard_days + shard_days - 1)
    calendar = lives.select(*keys, "shard", F.explode(F.sequence(from_, to)).alias("day_no"), "first_day", *[F.lit(0.0).alias(a) for a in amounts])
    last_shard = F.floor((F.col("day_no") + reach) / shard_days).cast("int")
    active = sparse.withColumn("shard", F.explode(F.sequence(shard("day_no"), last_shard))).withColumn("first_day", F.lit(None).cast("int"))
    rows = calendar.unionByName(active)
    over = lambda p: Window.partitionBy(*keys, "shard").orderBy("day_no").rangeBetween(-(p - 1), 0)
    totals = {f"total_{a}_{p}": F.sum(a).over(over(p)) for a in amounts for p in periods}
    summed = rows.withColumns(totals).where("first_day is not null")
    return summed.select(*keys, "day_no", "first_day", *totals, *[(F.col(f"total_{a}_{p}") / p).alias(f"mean_{a}_{p}") for a in amounts for p in periods])
