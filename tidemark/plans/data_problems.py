"""The pN_ queries whose operators live in the core, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.keys import micros, norm_key
from tidemark.operators.asof import asof_join, bitemporal_asof
from tidemark.operators.orphans import Parents, References, find_orphans, orphan_report
from tidemark.operators.regularize import latest_reading, regularize, session_of
from tidemark.operators.rolling import rolling_totals
from tidemark.operators.spikes import Field, find_spikes
from tidemark.operators.timestamps import normalize_times
from tidemark.sources.tables import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return find_orphans(
        [
            Parents("announcements", table(spark, folder, "announcements"), "event_id", "ingestion_timestamp", "deleted_at"),
            Parents("security_master", table(spark, folder, "security_master"), "security_id", "recorded_at", "deleted_at"),
        ],
        [
            References("estimates", table(spark, folder, "estimates"), "announcements", "event_id", "estimate_id", "estimate_timestamp", "ingested_at"),
            References("filings", table(spark, folder, "filings"), "announcements", "event_id", "filing_id", "filing_timestamp", "ingested_at"),
            References("prices", table(spark, folder, "prices"), "security_master", "security_id", "bar_id", "date", "ingested_at"),
        ],
    )


def p1_report(spark: SparkSession, folder: str) -> DataFrame:
    return orphan_report(p1_found(spark, folder))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    key = norm_key("event_id").alias("key")
    aligned = table(spark, folder, "event_master", "event_id", "security_id", "order_submission_cutoff").where("order_submission_cutoff is not null")
    aligned = aligned.select("event_id", key, norm_key("security_id").alias("security"), micros("order_submission_cutoff").alias("cutoff"))
    told = table(spark, folder, "announcements", "event_id", "announcement_timestamp").select(key, micros("announcement_timestamp").alias("told"))
    events = aligned.join(told.groupBy("key").agg(F.min("told").alias("told")), "key", "left")
    estimates = table(spark, folder, "estimates").select(key, micros("estimate_timestamp").alias("t"), F.col("estimate_id").alias("id"))
    features = table(spark, folder, "features").select(key, micros("feature_available_at").alias("t"), F.col("feature_id").alias("id"))
    securities = table(spark, folder, "security_master").select(
        norm_key("security_id").alias("key"), F.col("version_id").alias("id"), F.unix_date("valid_at").alias("valid"), micros("recorded_at").alias("recorded"), micros("deleted_at").alias("deleted")
    )
    parts = {
        "estimate": asof_join(events.select("event_id", "key", F.col("told").alias("t")), estimates),
        "feature": asof_join(aligned.select("event_id", "key", F.col("cutoff").alias("t")), features),
        "security": bitemporal_asof(events.select("event_id", F.col("security").alias("key"), F.col("told").alias("t")), securities),
    }
    found = [df.select("event_id", F.lit(kind).alias("kind"), "row_id") for kind, df in parts.items()]
    return found[0].unionByName(found[1]).unionByName(found[2])


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    feeds = table(spark, folder, "feed_sources")
    stamps = [("announcement_timestamp", "instant"), ("filing_timestamp", "instant")]
    told = normalize_times(table(spark, folder, "raw_announcements"), feeds, "raw_id", "source", stamps, zone="announcement_timezone", batch="batch_no", ordered=True)
    bars = normalize_times(table(spark, folder, "raw_bars"), feeds, "raw_id", "source", [("date", "date")])
    return told.unionByName(bars).withColumnRenamed("row_id", "raw_id")


def p3_history(spark: SparkSession, folder: str) -> DataFrame:
    """How well offset histories are found: every announcement's stamp is written as a wall time without zone, in the home
    zone of its source up to the middle of 2024 and in that of the next trusted source after it; the operator is told
    no zone, only when the row was loaded. Per source: texts, how many of them got their instant back, and the share."""
    feeds = table(spark, folder, "feed_sources")
    order = Window.orderBy("trust")
    after = F.coalesce(F.lead("home_zone").over(order), F.first("home_zone").over(order))
    zones = feeds.select("source", F.col("home_zone").alias("_first"), after.alias("_second"))
    told = table(spark, folder, "announcements", "event_id", "source", "announcement_timestamp", "ingestion_timestamp")
    real = told.where("announcement_timestamp > timestamp'1971-01-01' and announcement_timestamp < timestamp'2090-01-01' and ingestion_timestamp is not null")
    zone = F.when(F.col("ingestion_timestamp") < F.lit("2024-07-01").cast("timestamp"), F.col("_first")).otherwise(F.col("_second"))
    at = "yyyy-MM-dd HH:mm:ss.SSSSSS"
    written = real.join(zones, "source").select(
        F.xxhash64("event_id").alias("row"), "source", (F.year("ingestion_timestamp") * 4 + F.quarter("ingestion_timestamp")).alias("batch"), F.date_format("announcement_timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("true_form"),
        F.date_format(F.from_utc_timestamp("announcement_timestamp", zone), at).alias("told"), F.concat(F.date_format("ingestion_timestamp", at), F.lit("Z")).alias("loaded"),
    )
    hidden = feeds.select("source", F.lit(None).cast("string").alias("home_zone"), "date_order")
    got = normalize_times(written, hidden, "row", "source", [("told", "instant"), ("loaded", "instant")], batch="batch", ordered=True, longest_hours=2.5).where("field_name = 'told'")
    seen = written.join(got.select(F.col("row_id").alias("row"), F.col("normal_form")), "row", "left")
    right = F.count_if(F.col("normal_form") == F.col("true_form"))
    return seen.groupBy("source").agg(F.count(F.lit(1)).alias("texts"), right.alias("recovered"), (right / F.count(F.lit(1))).alias("share"))


SERIES = ["security_id", "contributor"]

#: Prices move by small ratios; volumes vary by several times, so their level is a median and a spike at least twelvefold.
READINGS = [Field("open", fence=8.0), Field("close", fence=8.0), Field("volume", fence=5.0, factor=12.0, level=5, zero_ok=True)]


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    bars = table(spark, folder, "prices", "bar_id", *SERIES, "date", "open", "close", "volume", "ingested_at").withColumn("security_id", norm_key("security_id"))
    return find_spikes(bars, SERIES, "bar_id", "date", "ingested_at", "volume", READINGS)


def p6_grid(spark: SparkSession, folder: str) -> DataFrame:
    sessions = table(spark, folder, "trading_sessions")
    bars = table(spark, folder, "prices", "security_id", "contributor", "date", "close", "ingested_at", "bar_id").withColumn("security_id", norm_key("security_id"))
    placed = session_of(bars.where("security_id is not null and close is not null"), "date", sessions, "ord")
    # a bar dated on the session itself goes before one moved to it from a closed day
    grid = regularize(placed, SERIES, "ord", "close", ["date", "ingested_at", "bar_id"], flag="settled")
    return grid.join(F.broadcast(sessions), "ord").select(*SERIES, F.date_format("session_date", "yyyy-MM-dd").alias("session_date"), "close", "filled", "settled")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return p6_grid(spark, folder).where("filled").select(*SERIES, "session_date")


def p7_trailing(spark: SparkSession, folder: str) -> DataFrame:
    bars = table(spark, folder, "prices", "security_id", "contributor", "date", "close", "volume", "ingested_at", "bar_id").withColumn("security_id", norm_key("security_id"))
    daily = latest_reading(bars.where("security_id is not null and date is not null"), SERIES, "date", ["volume", "close"], ["ingested_at", "bar_id"])
    full = rolling_totals(daily, SERIES, "date", ["volume", "close"], [7, 30])
    sums = [F.round(c, 6).alias(c) for c in full.columns if c.startswith(("total_", "mean_"))]  # the order of summation doesn't show
    return full.where("day_no >= first_day + 29").select(*SERIES, F.date_format(F.date_from_unix_date("day_no"), "yyyy-MM-dd").alias("calendar_day"), *sums)


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    week, month = F.col("total_volume_7"), F.col("total_volume_30")
    state = F.when(week == 0, "silent").when(week * 2 > month, "burst")
    return p7_trailing(spark, folder).select(*SERIES, "calendar_day", state.alias("state")).where("state is not null")


#: DuckDB's form of the key: without surrounding white space, upper case, null if blank.
KEY = "nullif(upper(trim({0}, ' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11) || chr(160))), '')"

P1 = f"""
WITH par AS (
  SELECT 'announcements' AS parent, {KEY.format('event_id')} AS k, ingestion_timestamp AS arrived, deleted_at FROM announcements
  UNION ALL SELECT 'security_master', {KEY.format('security_id')}, recorded_at, deleted_at FROM security_master),
agg AS (SELECT parent, k, count(*) FILTER (WHERE deleted_at IS NULL) AS live, min(arrived) FILTER (WHERE deleted_at IS NULL) AS arrived FROM par WHERE k IS NOT NULL GROUP BY 1, 2),
ref AS (
  SELECT 'estimates' AS table_name, 'announcements' AS parent, {KEY.format('event_id')} AS k, estimate_id AS row_id, strftime(estimate_timestamp AT TIME ZONE 'UTC', '%Y-%m') AS ref_month, ingested_at FROM estimates
  UNION ALL SELECT 'filings', 'announcements', {KEY.format('event_id')}, filing_id, strftime(filing_timestamp AT TIME ZONE 'UTC', '%Y-%m'), ingested_at FROM filings
  UNION ALL SELECT 'prices', 'security_master', {KEY.format('security_id')}, bar_id, strftime(date, '%Y-%m'), ingested_at FROM prices)
SELECT table_name, row_id, ref_month, CASE WHEN a.k IS NULL THEN 'missing' WHEN a.live = 0 THEN 'deleted' ELSE 'late' END AS reason
FROM ref LEFT JOIN agg a ON a.parent = ref.parent AND a.k = ref.k
WHERE ref.k IS NOT NULL AND (a.k IS NULL OR a.live = 0 OR a.arrived > ref.ingested_at)
"""

P2 = f"""
WITH ev AS (
  SELECT m.event_id, {KEY.format('m.event_id')} AS k, {KEY.format('m.security_id')} AS s, order_submission_cutoff AS cutoff, a.announcement_timestamp AS told
  FROM event_master m LEFT JOIN announcements a ON {KEY.format('a.event_id')} = {KEY.format('m.event_id')} WHERE order_submission_cutoff IS NOT NULL)
SELECT event_id, 'estimate' AS kind, row_id FROM (
  SELECT ev.event_id, estimate_id AS row_id, row_number() OVER (PARTITION BY ev.event_id ORDER BY estimate_timestamp DESC, estimate_id) AS rn
  FROM ev JOIN estimates e ON {KEY.format('e.event_id')} = ev.k AND e.estimate_timestamp < ev.told) WHERE rn = 1
UNION ALL
SELECT event_id, 'feature', row_id FROM (
  SELECT ev.event_id, feature_id AS row_id, row_number() OVER (PARTITION BY ev.event_id ORDER BY feature_available_at DESC, feature_id) AS rn
  FROM ev JOIN features f ON {KEY.format('f.event_id')} = ev.k AND f.feature_available_at < ev.cutoff) WHERE rn = 1
UNION ALL
SELECT event_id, 'security', row_id FROM (
  SELECT ev.event_id, version_id AS row_id, row_number() OVER (PARTITION BY ev.event_id ORDER BY valid_at DESC, recorded_at DESC, version_id) AS rn
  FROM ev JOIN security_master v ON {KEY.format('v.security_id')} = ev.s AND v.recorded_at < ev.told AND (v.deleted_at IS NULL OR v.deleted_at > ev.told)
    AND v.valid_at <= CAST(ev.told AT TIME ZONE 'America/New_York' AS DATE)) WHERE rn = 1
"""

BARS = f"SELECT *, {KEY.format('security_id')} AS s FROM prices"

P6 = f"""
WITH ses AS (SELECT session_date, ord, lead(session_date) OVER (ORDER BY session_date) AS nxt FROM trading_sessions),
b AS (SELECT DISTINCT s, contributor, ord FROM ({BARS}) p JOIN ses ON p.date >= ses.session_date AND (ses.nxt IS NULL OR p.date < ses.nxt) WHERE s IS NOT NULL AND close IS NOT NULL),
life AS (SELECT s, contributor, min(ord) AS lo, max(ord) AS hi FROM b GROUP BY 1, 2)
SELECT life.s AS security_id, life.contributor, strftime(ses.session_date, '%Y-%m-%d') AS session_date
FROM life JOIN ses ON ses.ord > lo AND ses.ord < hi ANTI JOIN b ON b.s = life.s AND b.contributor IS NOT DISTINCT FROM life.contributor AND b.ord = ses.ord
"""

P7 = f"""
WITH d AS (SELECT s, contributor, date, greatest(coalesce(volume, 0), 0) AS volume, greatest(coalesce(close, 0), 0) AS close FROM ({BARS}) WHERE s IS NOT NULL AND date IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY s, contributor, date ORDER BY ingested_at DESC, bar_id DESC) = 1),
life AS (SELECT s, contributor, min(date) AS lo, max(date) AS hi FROM d GROUP BY 1, 2),
cal AS (SELECT s, contributor, lo, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS day FROM life),
f AS (SELECT cal.*, coalesce(volume, 0) AS v, coalesce(close, 0) AS c FROM cal LEFT JOIN d ON d.s = cal.s AND d.contributor IS NOT DISTINCT FROM cal.contributor AND d.date = cal.day),
t AS (SELECT s AS security_id, contributor, strftime(day, '%Y-%m-%d') AS calendar_day, day - lo AS age,
  sum(v) OVER w7 AS total_volume_7, sum(v) OVER w30 AS total_volume_30, sum(c) OVER w7 AS total_close_7, sum(c) OVER w30 AS total_close_30
  FROM f WINDOW w7 AS (PARTITION BY s, contributor ORDER BY day ROWS 6 PRECEDING), w30 AS (PARTITION BY s, contributor ORDER BY day ROWS 29 PRECEDING))
"""

QUERIES = {"p1_found": p1_found, "p1_report": p1_report, "p2_found": p2_found, "p3_found": p3_found, "p3_history": p3_history, "p5_found": p5_found, "p6_found": p6_found, "p6_grid": p6_grid, "p7_found": p7_found, "p7_trailing": p7_trailing}
SQL = {"p1_found": P1, "p2_found": P2, "p1_report": f"SELECT table_name, ref_month, reason, count(*) AS n FROM ({P1}) GROUP BY 1, 2, 3", "p6_found": P6,
    "p7_found": P7 + "SELECT security_id, contributor, calendar_day, CASE WHEN total_volume_7 = 0 THEN 'silent' ELSE 'burst' END AS state FROM t WHERE age >= 29 AND (total_volume_7 = 0 OR total_volume_7 * 2 > total_volume_30)",
    "p7_trailing": P7 + "SELECT security_id, contributor, calendar_day, " + ", ".join(f"round(total_{a}_{p}, 6) AS total_{a}_{p}, round(total_{a}_{p} / {p}, 6) AS mean_{a}_{p}" for a in ("volume", "close") for p in (7, 30)) + " FROM t WHERE age >= 29"}
