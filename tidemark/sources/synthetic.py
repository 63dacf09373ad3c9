"""A synthetic event-study data set with a planted signal, generated in Spark.

Every random number is a hash of (seed, purpose, keys), so the tables don't depend on
partitioning, core count or the day they are made, and any row can be recomputed alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.calendar import at_clock, day_table, exchange_sessions, with_day
from tidemark.operators.features import standardize
from tidemark.operators.securities import build_master, cap_bucket
from tidemark.sources.io import provider

SECTORS = ["Technology", "Health", "Energy", "Finance", "Consumer", "Industry"]
#: Strength of the planted signal: on the whole, its loss a year, what is left of it in the drift, by size, for volatile securities (parameters).
STRENGTH, LOSS, DRIFT, SIZES, VOLATILE = 0.25, 0.02, 0.6, {"small_cap": 1.3, "mid_cap": 1.0, "large_cap": 0.7}, 1.2
WORDS = {1: ["strong", "growth", "record", "robust", "beat"], 0: ["weak", "decline", "pressure", "below", "risk"]}


def uniform(seed: int, purpose: str, *keys: Column | str) -> Column:
    """A number in (0, 1) that is the same for the same keys."""
    h = F.xxhash64(F.lit(seed), F.lit(purpose), *keys)
    return (F.shiftrightunsigned(h, 11).cast("double") + 0.5) / float(1 << 53)


def normal(seed: int, purpose: str, *keys: Column | str) -> Column:
    """A standard normal number (Box-Muller)."""
    return F.sqrt(-2 * F.ln(uniform(seed, purpose + "/r", *keys))) * F.cos(2 * math.pi * uniform(seed, purpose + "/a", *keys))


def make_stocks(spark: SparkSession, n: int, seed: int) -> DataFrame:
    sid = F.format_string("S%04d", F.col("id"))
    cap = F.exp(math.log(3e8) + uniform(seed, "cap", "id") * (math.log(4e11) - math.log(3e8)))
    return spark.range(n).select(
        sid.alias("security_id"),
        F.format_string("T%03d", F.col("id")).alias("ticker"),
        (F.col("id") + 1_000_000).alias("cik"),
        F.format_string("Company %03d", F.col("id")).alias("company_name"),
        F.lit("2010-01-04").cast("date").alias("listing_date"),
        (1 + 0.3 * normal(seed, "beta", "id")).alias("beta"),
        F.element_at(F.array(*map(F.lit, SECTORS)), (F.floor(uniform(seed, "sector", "id") * len(SECTORS)) + 1).cast("int")).alias("sector"),
        cap.alias("market_cap"),
        cap_bucket(cap).alias("cap_bucket"),
        F.greatest(F.lit(5.0), 50 + 20 * normal(seed, "price", "id")).alias("first_price"),
        F.exp(math.log(0.3) + 0.3 * normal(seed, "vol", "id")).alias("annual_vol"),
        (0.06 + 0.04 * normal(seed, "drift", "id")).alias("annual_drift"),
    ).withColumn("industry", F.concat("sector", F.lit(" services")))


def make_bars(stocks: DataFrame, sessions: DataFrame, seed: int) -> DataFrame:
    """A geometric price path per stock: the product of its returns, as a running sum of logarithms."""
    move = F.col("annual_drift") / 252 + F.col("annual_vol") / math.sqrt(252) * normal(seed, "return", "security_id", "ord")
    # stocks x sessions is the table itself, not an intermediate product
    rows = stocks.crossJoin(F.broadcast(sessions)).withColumn("move", F.greatest(move, F.lit(-0.9)))
    order = Window.partitionBy("security_id").orderBy("ord")
    close = F.col("first_price") * F.exp(F.sum(F.log1p("move")).over(order))
    priced = rows.withColumn("close", close).withColumn("before", F.coalesce(F.lag("close").over(order), F.col("first_price")))
    reach = lambda side: F.abs(normal(seed, side, "security_id", "ord")) * F.col("annual_vol") * (0.5 / math.sqrt(252))
    high = F.col("before") * (1 + F.greatest(F.col("move"), F.lit(0.0)) + reach("high"))
    low = F.col("before") * F.greatest(F.lit(0.01), 1 + F.least(F.col("move"), F.lit(0.0)) - reach("low"))
    volume = F.greatest(F.lit(1e5), F.exp(14 + normal(seed, "volume", "security_id", "ord")))
    return priced.select(
        "security_id", "sector", F.col("session_date").alias("date"), "ord", (F.col("before") * (1 + 0.4 * F.col("move"))).alias("open"), high.alias("high"), low.alias("low"), "close", F.round(volume).alias("volume"),
        F.col("close").alias("unadjusted_close"), F.col("close").alias("adjusted_close"), F.lit(0.0).alias("dividend"), F.lit(1.0).alias("split_factor"),
    )


def make_path(sessions: DataFrame, names: DataFrame, key: str, start: float, drift: float, spread: float, seed: int) -> DataFrame:
    """A price path of its own per name: a benchmark, or one per sector. ``names`` x sessions is the table itself."""
    rows = names.select(key).distinct().crossJoin(F.broadcast(sessions)).withColumn("move", F.greatest(drift + spread * normal(seed, "path", key, "ord"), F.lit(-0.9)))
    order = Window.partitionBy(key).orderBy("ord")
    walked = rows.withColumn("close", start * F.exp(F.sum(F.log1p("move")).over(order)))
    opening = F.coalesce(F.lag("close").over(order), F.lit(start))
    return walked.select(key, F.col("session_date").alias("date"), "ord", opening.alias("open"), "close", opening.alias("high"), opening.alias("low"), F.lit(0.0).alias("volume"))


def make_events(stocks: DataFrame, days: DataFrame, first_year: int, last_year: int, seed: int, signal: float) -> DataFrame:
    """Four announcements a year per stock, with surprises and planted reactions that scale with them."""
    quarters = stocks.withColumn("fiscal_year", F.explode(F.sequence(F.lit(first_year), F.lit(last_year)))).withColumn("fiscal_quarter", F.explode(F.array(*[F.lit(q) for q in (1, 2, 3, 4)])))
    end = F.last_day(F.make_date("fiscal_year", F.col("fiscal_quarter") * 3, F.lit(1)))
    keys = ("security_id", "fiscal_year", "fiscal_quarter")
    told = quarters.withColumn("fiscal_period_end", end).withColumn("_day", F.date_add(end, (20 + F.floor(uniform(seed, "lag", *keys) * 30)).cast("int")))
    on = with_day(told, "_day", days, {"is_session": "_open", "next_session": "_next"}).withColumn("_day", F.when(F.col("_open"), F.col("_day")).otherwise(F.col("_next")))
    dice = uniform(seed, "timing", *keys)
    timing = F.when(dice < 0.4, "before_market_open").when(dice < 0.85, "after_market_close").when(dice < 0.95, "intraday").otherwise("unknown")
    stamp = F.when(timing == "before_market_open", at_clock("_day", 8, 5)).when(timing == "after_market_close", at_clock("_day", 16, 5)).when(timing == "intraday", at_clock("_day", 12, 0)).otherwise(at_clock("_day", 10, 0))
    estimate = F.exp(0.3 * normal(seed, "eps", *keys))
    z = normal(seed, "surprise", *keys)
    sales = F.col("market_cap") * 0.05
    told = on.withColumns({"surprise_pct": 6 * z, "_stamp": stamp, "_timing": timing})
    rows = standardize(told, "surprise_pct", "_z")
    size = F.when(F.col("cap_bucket") == "small_cap", SIZES["small_cap"]).when(F.col("cap_bucket") == "mid_cap", SIZES["mid_cap"]).otherwise(SIZES["large_cap"])
    strength = signal * STRENGTH * size * F.when(F.col("annual_vol") >= 0.4, VOLATILE).otherwise(1.0) * F.greatest(F.lit(0.05), 1 - LOSS * (F.col("fiscal_year") - first_year))
    stamp, timing, z = F.col("_stamp"), F.col("_timing"), F.col("_z")
    return rows.select(
        F.concat_ws("-", "security_id", "fiscal_year", "fiscal_quarter").alias("event_id"), "security_id", "ticker", F.col("ticker").alias("ticker_at_event"), "cik", "company_name", "sector", "industry", "cap_bucket", F.col("market_cap").alias("market_cap_at_event"), "beta", "annual_vol", "surprise_pct", F.lit("synthetic").alias("source"),
        F.concat_ws("-", F.lit("A"), "security_id", "fiscal_year", "fiscal_quarter").alias("filing_accession_number"), "fiscal_year", "fiscal_quarter", "fiscal_period_end",
        timing.alias("timing_class"), stamp.alias("announcement_timestamp"), F.timestamp_micros(F.unix_micros(stamp) - 3 * 86_400_000_000).alias("estimate_timestamp"), F.timestamp_micros(F.unix_micros(stamp) + 3_600_000_000).alias("filing_timestamp"),
        estimate.alias("estimated_eps"), (estimate * (1 + F.col("surprise_pct") / 100)).alias("actual_eps"), sales.alias("estimated_revenue"), (sales * (1 + 0.02 * normal(seed, "sales", *keys))).alias("actual_revenue"),
        (strength * z * 0.02 + 0.005 * normal(seed, "noise", *keys)).alias("planted_reaction"), (strength * z * 0.02 * DRIFT + 0.003 * normal(seed, "noise2", *keys)).alias("planted_drift"),
        (F.col("annual_vol") / math.sqrt(252) * (1 + 0.3 * z + 0.1 * normal(seed, "noise3", *keys))).alias("planted_volatility"),
    )


def make_filings(events: DataFrame) -> DataFrame:
    """One text per event whose words lean with the surprise."""
    lean = (F.col("actual_eps") > F.col("estimated_eps")).cast("int")
    pick = F.when(lean == 1, F.array(*map(F.lit, WORDS[1]))).otherwise(F.array(*map(F.lit, WORDS[0])))
    text = F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: F.when(i % 3 == 0, F.element_at(pick, (i % 5 + 1).cast("int"))).otherwise("results")))
    return events.select("filing_accession_number", "event_id", "security_id", F.lit("8-K").alias("filing_type"), "filing_timestamp", F.lit("earnings_release").alias("section"), text.alias("text"), F.length(text).cast("long").alias("n_chars"))


def make_estimates(events: DataFrame, seed: int) -> DataFrame:
    """One consensus per event, with the number of analysts behind it."""
    analysts = (3 + F.floor(uniform(seed, "analysts", "event_id") * 22)).cast("int")
    return events.select("event_id", "security_id", "estimate_timestamp", "estimated_eps", "estimated_revenue", analysts.alias("n_analysts"))


@provider("synthetic")
def synthetic(spark: SparkSession, stocks: int = 30, start: str = "2015-01-02", end: str = "2025-12-31", seed: int = 42, signal: float = 1.0) -> dict[str, DataFrame]:
    """sessions, stocks, security_master, bars, benchmark, sector_bars, events, estimates, filings. ``signal`` 0 plants nothing (negative control)."""
    sessions = exchange_sessions(spark, start, end)
    listed = make_stocks(spark, stocks, seed)
    events = make_events(listed, day_table(sessions), int(start[:4]), int(end[:4]) - 1, seed, signal)
    index = spark.range(1).select(F.lit("INDEX").alias("ticker"))
    return {
        "sessions": sessions, "stocks": listed, "security_master": build_master(listed), "bars": make_bars(listed, sessions, seed), "benchmark": make_path(sessions, index, "ticker", 200.0, 0.0002, 0.01, seed),
        "sector_bars": make_path(sessions, listed, "sector", 100.0, 0.0001, 0.009, seed), "events": events, "estimates": make_estimates(events, seed), "filings": make_filings(events),
    }
