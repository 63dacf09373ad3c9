"""Event-study views over the test tables: cleaned events, one bar per security and session, predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.keys import norm_key
from tidemark.operators.calendar import day_table
from tidemark.operators.regularize import latest_reading
from tidemark.sources.tables import table

ZONE = "America/New_York"


def sessions(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "trading_sessions", "session_date", "ord")


def days(spark: SparkSession, folder: str) -> DataFrame:
    return day_table(sessions(spark, folder))


def within(name: str, low: float, high: float) -> Column:
    return F.when((F.col(name) > low) & (F.col(name) < high), F.col(name)).alias(name)


def dated(name: str) -> Column:
    """A stamp, null where it is a stand-in (outside 1971 to 2090)."""
    return F.when((F.col(name) > F.lit("1971-01-01").cast("timestamp")) & (F.col(name) < F.lit("2090-01-01").cast("timestamp")), F.col(name)).alias(name)


def events(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "announcements").where("deleted_at is null").withColumn("security_id", norm_key("security_id")).where("security_id is not null")
    return rows.select(
        "event_id", "security_id", "sector", "cap_bucket", "market_cap_at_event", "fiscal_year", "fiscal_period_end", "timing_class", "estimate_timestamp",
        dated("announcement_timestamp"), dated("filing_timestamp"),
        within("actual_eps", -900.0, 900.0), within("estimated_eps", -900.0, 900.0), within("actual_revenue", 0.0, 1e14), within("estimated_revenue", 0.0, 1e14),
    )


def bars(spark: SparkSession, folder: str) -> DataFrame:
    """security_id, ord, open, close, volume: the latest loaded bar with prices above 0."""
    rows = table(spark, folder, "prices", "security_id", "date", "open", "close", "volume", "ingested_at", "bar_id").withColumn("security_id", norm_key("security_id"))
    fine = rows.where("security_id is not null and open > 0 and close > 0").withColumn("volume", F.greatest(F.coalesce("volume", F.lit(0.0)), F.lit(0.0)))
    placed = fine.join(F.broadcast(sessions(spark, folder)), F.col("date") == F.col("session_date"))
    return latest_reading(placed, ["security_id"], "ord", ["open", "close", "volume"], ["ingested_at", "bar_id"])


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    """model, fold, event_id, prediction, actual from the stream table: a value predicts its user's next change."""
    rows = table(spark, folder, "events", "event_id", "ts", "user_id", "event_type", "value")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    week = F.concat(F.lit("week_"), F.floor(F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) / 7))
    return rows.select(F.col("event_type").alias("model"), week.alias("fold"), "event_id", F.col("value").alias("prediction"), (F.lead("value").over(order) - F.col("value")).alias("actual"))
