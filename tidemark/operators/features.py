"""Point-in-time features of events: surprises, market context, availability.

Market context is computed once per bar with trailing windows, and each event takes the
last bar strictly before its entry through a merge on (security, session), never through
a scan of the bars per event.

Defined cases: divisions by zero or by nearly nothing give null; windows shorter than
required give null; ties in time are broken by event_id; null inputs stay null, but
``beat`` is 0 without a surprise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.ranks import exact_quantiles


def relative_surprise(actual: str, estimate: str) -> Column:
    base = F.abs(estimate)
    return F.when(base > 1e-6, (F.col(actual) - F.col(estimate)) / base)


def surprises(events: DataFrame, when: str = "effective_date") -> DataFrame:
    """Adds eps and revenue surprises, standardised surprise, beat, streak and previous surprise.

    The standard deviation runs over the security's earlier surprises only (two at least).
    """
    base = events.withColumns({"eps_surprise": F.col("actual_eps") - F.col("estimated_eps"), "eps_surprise_pct": relative_surprise("actual_eps", "estimated_eps"), "rev_surprise": F.col("actual_revenue") - F.col("estimated_revenue"), "rev_surprise_pct": relative_surprise("actual_revenue", "estimated_revenue")})
    order = Window.partitionBy("security_id").orderBy(when, "event_id")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    spread = F.when(F.count("eps_surprise_pct").over(earlier) >= 2, F.stddev_samp("eps_surprise_pct").over(earlier))
    beat = F.coalesce((F.col("eps_surprise") > 0).cast("int"), F.lit(0))
    step = base.withColumns({"surprise_std_hist": spread, "beat": beat, "prev_surprise_pct": F.lag("eps_surprise_pct").over(order)})
    step = step.withColumn("sue", F.try_divide("eps_surprise_pct", F.nullif("surprise_std_hist", F.lit(0.0))))
    # islands of equal outcomes: a run number, then the running count inside it
    turn = step.withColumn("_turn", F.coalesce((F.col("beat") != F.lag("beat").over(order)).cast("int"), F.lit(1))).withColumn("_run", F.sum("_turn").over(order))
    inside = Window.partitionBy("security_id", "_run").orderBy(when, "event_id")
    return turn.withColumn("beat_streak", (F.sum("beat").over(inside) * F.col("beat")).cast("int")).drop("_turn", "_run")


MARKET = ["mom_1m", "mom_3m", "mom_6m", "dist_high", "rv_3m", "downside_vol_3m", "volume_surprise", "short_term_reversal"]


def bar_context(bars: DataFrame, columns: list[str] | None = None, short: int = 21, mid: int = 63, long: int = 126, volatility: int = 63, volume: int = 63) -> DataFrame:
    """Per bar (security_id, ord, close, volume), its number ``n`` and the trailing measures (all of MARKET, or ``columns``) as of its close."""
    columns = MARKET if columns is None else columns
    order = Window.partitionBy("security_id").orderBy("ord")
    last = lambda n: order.rowsBetween(-(n - 1), 0)
    back = lambda n: F.try_divide("close", F.lag("close", n).over(order)) - 1
    base = bars.select("security_id", "ord", "close", "volume").withColumns({"n": F.row_number().over(order), "ret": back(1)})
    if "downside_vol_3m" in columns:
        # the last k falling returns: a window over the falling bars alone, on the same partitioning
        fell = Window.partitionBy("security_id", "_down").orderBy("ord").rowsBetween(-(volatility - 1), 0)
        base = base.withColumn("_down", F.coalesce(F.col("ret") < 0, F.lit(False)))
        base = base.withColumn("_fall", F.when(F.col("_down"), F.stddev_samp("ret").over(fell)))
    measures = {
        "mom_1m": lambda: back(short),
        "mom_3m": lambda: back(mid),
        "mom_6m": lambda: back(long),
        "dist_high": lambda: F.when(F.col("n") >= long, F.try_divide("close", F.max("close").over(last(long))) - 1),
        "rv_3m": lambda: F.stddev_samp("ret").over(last(volatility)),
        "downside_vol_3m": lambda: F.last("_fall", True).over(order),
        "volume_surprise": lambda: F.try_divide("volume", F.avg("volume").over(last(volume))) - 1,
        "short_term_reversal": lambda: F.sum("ret").over(last(5)),
    }
    return base.select("security_id", "ord", "n", *[measures[c]().alias(c) for c in columns])


def market_context(events: DataFrame, bars: DataFrame, least: int = 131, columns: list[str] | None = None, **windows: int) -> DataFrame:
    """event_id and MARKET (or ``columns`` of it) as of the last bar strictly before the event's entry (event columns security_id, entry_ord).

    Null where that bar has fewer than ``least`` bars up to it. One merge of bars and events; a security has one bar a session.
    """
    columns = MARKET if columns is None else columns
    context = bar_context(bars, columns, **windows)
    # an event without security meets no bar and stands alone
    owner = F.coalesce("security_id", F.concat(F.lit("\0"), F.col("event_id").cast("string")))
    asked = events.select(owner.alias("security_id"), F.col("entry_ord").alias("ord"), F.lit(1).alias("_kind"), "event_id")
    told = context.select("security_id", "ord", F.lit(0).alias("_kind"), F.struct("n", *columns).alias("_bar"))
    # an event sorts before the bar of its own session, one without session before all
    order = Window.partitionBy("security_id").orderBy("ord", F.col("_kind").desc(), "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = told.unionByName(asked, allowMissingColumns=True).withColumn("_bar", F.last("_bar", True).over(order)).where("_kind = 1")
    return seen.select("event_id", *[F.when(F.col("_bar.n") >= least, F.col(f"_bar.{c}")).alias(c) for c in columns])


def latest_availability(parts: list[str]) -> Column:
    """When a merged row is available: the latest of its parts' stamps, nulls left out."""
    return F.greatest(*parts)


def winsorize(df: DataFrame, column: str, low: float = 0.005, high: float = 0.995) -> DataFrame:
    """Clips a column at two exact quantiles of the whole table (one row broadcast); null stays null."""
    ends = exact_quantiles(df, [], column, [low, high], "_q")
    clipped = F.when(F.col(column).isNotNull(), F.greatest(F.least(F.col(column), F.col("_q")[1]), F.col("_q")[0]))
    return df.join(F.broadcast(ends)).withColumn(column, clipped).drop("_q")


def standardize(df: DataFrame, column: str, out: str) -> DataFrame:
    """Adds a column less its mean over its deviation, both over the whole table (one row broadcast)."""
    ends = df.agg(F.avg(column).alias("_mean"), F.stddev_pop(column).alias("_spread"))
    return df.join(F.broadcast(ends)).withColumn(out, (F.col(column) - F.col("_mean")) / (F.col("_spread") + 1e-9)).drop("_mean", "_spread")
