"""Alignment of timed events to exchange sessions, and their de-duplication.

Defined cases: an event without a stamp has no effective date and the status
'missing_announcement_ts'; an unknown class raises; of events of one security and
period the earliest stays (ties: smallest event_id), a null stamp last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.calendar import at_clock, market_date, shift_table, with_day

CLASSES = ["before_market_open", "after_market_close", "intraday", "unknown"]


def effective_dates(events: DataFrame, days: DataFrame, stamp: str = "announcement_timestamp", timing: str = "timing_class") -> DataFrame:
    """Adds market_date, effective_date: the session an event can first be traded in.

    An event before the open of a session day counts for that day, any other for the next session.
    """
    known = F.when(F.col(timing).isin(CLASSES), F.col(timing)).otherwise(F.raise_error(F.concat(F.lit("unknown timing class: "), F.coalesce(timing, F.lit("null")))))
    dated = with_day(events.withColumn("market_date", market_date(stamp)), "market_date", days, {"is_session": "__open", "next_session": "__next"})
    same_day = (known == CLASSES[0]) & F.col("__open")
    return dated.withColumn("effective_date", F.when(same_day, F.col("market_date")).otherwise(F.col("__next"))).drop("__open", "__next")


def first_per_period(events: DataFrame, keys: list[str], stamp: str, tie: str) -> DataFrame:
    """Keeps the earliest row per key. Only (stamp, tie) decide, so rows are combined before the shuffle."""
    # min over a struct reduces on the map side; a row_number would sort whole groups
    rank = F.struct(F.col(stamp).isNull().alias("late"), F.col(stamp).alias("at"), F.col(tie).alias("id"))
    rest = [c for c in events.columns if c not in keys]
    return events.groupBy(*keys).agg(F.min(F.struct(rank.alias("rank"), *rest)).alias("row")).select(*keys, *[F.col(f"row.{c}").alias(c) for c in rest])


def event_master(events: DataFrame, days: DataFrame, sessions: DataFrame, reaction: int = 1, drift: int = 20) -> DataFrame:
    """Aligned, stamped and de-duplicated events with entry and exit sessions.

    Adds market_date, effective_date, exclusion_reason, prediction_timestamp (9:35), order_submission_cutoff (9:25),
    entry_session, reaction_exit, drift_exit, their ordinals entry_ord, rx_ord, dx_ord, and data_quality_status. Duplicates are dropped before exclusion is looked at.
    """
    aligned = effective_dates(events, days)
    reason = F.when(F.col("timing_class") == "intraday", "timing_intraday").when(F.col("timing_class") == "unknown", "timing_unknown").otherwise("")
    prior = F.coalesce("exclusion_reason", F.lit("")) if "exclusion_reason" in events.columns else F.lit("")
    stamped = aligned.withColumns(
        {
            "exclusion_reason": F.trim(F.concat(prior, F.when(F.contains(prior, reason), F.lit("")).otherwise(reason))),
            "prediction_timestamp": at_clock("effective_date", 9, 35),
            "order_submission_cutoff": at_clock("effective_date", 9, 25),
        }
    )
    single = first_per_period(stamped, ["security_id", "fiscal_period_end"], "announcement_timestamp", "event_id")
    table = shift_table(days, sessions, {"entry": 0, "rx": reaction, "dx": drift})
    exits = with_day(single.drop("entry_session"), "effective_date", table, {"entry": "entry_session", "rx": "reaction_exit", "dx": "drift_exit", "near_ord": "entry_ord", "rx_ord": "rx_ord", "dx_ord": "dx_ord"})
    status = F.when(F.col("announcement_timestamp").isNull(), "missing_announcement_ts").when(F.col("exclusion_reason") != "", "excluded").otherwise("ok")
    return exits.withColumn("data_quality_status", status)


def primary(master: DataFrame) -> DataFrame:
    """Events without an exclusion."""
    return master.where(F.coalesce("exclusion_reason", F.lit("")) == "")


def alignment_report(master: DataFrame, days: DataFrame) -> DataFrame:
    """Per event, whether its effective date keeps the rules (UTC date of the stamp, as the rule is stated)."""
    told = F.to_date("announcement_timestamp")
    seen = with_day(master, "effective_date", days, {"is_session": "__open"})
    when = lambda c, ok: F.when(F.col("timing_class") == c, F.coalesce(ok, F.lit(False))).otherwise(F.lit(True))
    return seen.select(
        "event_id",
        F.coalesce("__open", F.lit(False)).alias("is_session"),
        when("after_market_close", F.col("effective_date") > told).alias("amc_next_session_ok"),
        when("before_market_open", F.col("effective_date") == told).alias("bmo_same_session_ok"),
        F.when(F.col("timing_class").isin("intraday", "unknown"), F.col("exclusion_reason") != "").otherwise(F.lit(True)).alias("excluded_ok"),
    )


def golden_report(cases: DataFrame, days: DataFrame) -> DataFrame:
    """Accuracy of effective dates against expected ones: n, accuracy, valid classes, share of repeated (ticker, stamp) rows."""
    valid = F.col("timing_class").isin(CLASSES)
    dated = effective_dates(cases.withColumns({"_told": F.col("timing_class"), "timing_class": F.when(valid, F.col("timing_class")).otherwise("unknown")}), days)
    valid = F.col("_told").isin(CLASSES)
    right = F.coalesce(F.col("effective_date") == F.col("expected_effective_date"), F.lit(False)).cast("int")
    # equal (ticker, stamp) rows are combined before the shuffle; each but the first is a repeat
    each = dated.withColumn("_valid", valid.cast("int")).groupBy("ticker", "announcement_timestamp").agg(F.count(F.lit(1)).alias("n"), F.sum(right).alias("right"), F.sum(F.coalesce("_valid", F.lit(0))).alias("valid"))
    n = F.sum("n")
    share = lambda c: F.try_divide(c, n.cast("double"))
    return each.agg(F.coalesce(n, F.lit(0)).alias("n"), share(F.sum("right")).alias("effective_date_accuracy"), share(F.sum("valid")).alias("timing_valid_rate"), share(n - F.count(F.lit(1))).alias("duplicate_rate"))
