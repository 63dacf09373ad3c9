"""Queries for the event-study operators, each with SQL that computes the same from the tables alone."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.keys import norm_key
from tidemark.operators import alignment, evaluation, features, integrity, labels, models, ranks, securities, tone
from tidemark.operators import calendar as cal
from tidemark.plans import views
from tidemark.plans.data_problems import KEY
from tidemark.session import shared_folder
from tidemark.sources import contracts
from tidemark.sources.tables import table
from tidemark.streaming import stream

DIGITS = 8
STAMP = "yyyy-MM-dd'T'HH:mm:ss'Z'"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to DIGITS places, so that the order of summation doesn't show; instants as UTC text."""
    form = {"double": lambda c: F.round(c, DIGITS), "timestamp": lambda c: F.date_format(c, STAMP)}
    return df.select(*[form[t](c).alias(c) if t in form else F.col(c) for c, t in df.dtypes])


def register(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = lambda spark, folder: rounded(f(spark, folder))
        if sql:
            SQL[name] = sql
        return f

    return keep


def utc(expr: str, name: str) -> str:
    return f"strftime(({expr}) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS {name}"


def r(*names: str) -> str:
    return ", ".join(f"round({n}, {DIGITS}) AS {n}" for n in names)


# ---- SQL views: the same cleaning as plans/views.py, written independently ----
S_DIM = """
day AS (SELECT CAST(unnest(generate_series((SELECT min(session_date) FROM trading_sessions) - INTERVAL 400 DAY, (SELECT max(session_date) FROM trading_sessions) + INTERVAL 400 DAY, INTERVAL 1 DAY)) AS DATE) AS day),
dim AS (SELECT day, s.ord IS NOT NULL AS is_session, s.ord,
  last_value(s.session_date IGNORE NULLS) OVER b AS prev_session, last_value(s.ord IGNORE NULLS) OVER b AS prev_ord,
  first_value(s.session_date IGNORE NULLS) OVER a AS next_session, first_value(s.ord IGNORE NULLS) OVER a AS next_ord
  FROM day LEFT JOIN trading_sessions s ON s.session_date = day.day
  WINDOW b AS (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a AS (ORDER BY day ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
near AS (SELECT *, CASE WHEN is_session THEN ord WHEN prev_session IS NULL OR (next_session IS NOT NULL AND next_session - day <= day - prev_session) THEN next_ord ELSE prev_ord END AS near_ord FROM dim)
"""
_time = lambda c: f"CASE WHEN {c} > TIMESTAMPTZ '1971-01-01 00:00:00+00' AND {c} < TIMESTAMPTZ '2090-01-01 00:00:00+00' THEN {c} END AS {c}"
_num = lambda c, a, b: f"CASE WHEN {c} > {a} AND {c} < {b} THEN {c} END AS {c}"
S_EV = f"""
ev AS (SELECT event_id, {KEY.format('security_id')} AS security_id, sector, cap_bucket, market_cap_at_event, fiscal_year, fiscal_period_end, timing_class, estimate_timestamp,
  {_time('announcement_timestamp')}, {_time('filing_timestamp')}, {_num('actual_eps', -900, 900)}, {_num('estimated_eps', -900, 900)}, {_num('actual_revenue', 0, 1e14)}, {_num('estimated_revenue', 0, 1e14)}
  FROM announcements WHERE deleted_at IS NULL AND {KEY.format('security_id')} IS NOT NULL),
evd AS (SELECT *, CAST(announcement_timestamp AT TIME ZONE 'America/New_York' AS DATE) AS market_date FROM ev)
"""
S_EFF = f"""{S_DIM}, {S_EV},
eff AS (SELECT evd.*, CASE WHEN timing_class = 'before_market_open' AND dim.is_session THEN market_date ELSE dim.next_session END AS effective_date FROM evd LEFT JOIN dim ON dim.day = market_date)
"""
S_MASTER = f"""{S_EFF},
one AS (SELECT * FROM eff QUALIFY row_number() OVER (PARTITION BY security_id, fiscal_period_end ORDER BY announcement_timestamp NULLS LAST, event_id) = 1),
top AS (SELECT max(ord) AS m FROM trading_sessions),
mst AS (SELECT one.*, CASE timing_class WHEN 'intraday' THEN 'timing_intraday' WHEN 'unknown' THEN 'timing_unknown' ELSE '' END AS exclusion_reason,
  (effective_date + INTERVAL 9 HOUR + INTERVAL 35 MINUTE) AT TIME ZONE 'America/New_York' AS prediction_timestamp,
  (effective_date + INTERVAL 9 HOUR + INTERVAL 25 MINUTE) AT TIME ZONE 'America/New_York' AS order_submission_cutoff,
  near.near_ord AS entry_ord, CASE WHEN near_ord IS NOT NULL THEN greatest(0, least(near.near_ord + 1, top.m)) END AS rx_ord, CASE WHEN near_ord IS NOT NULL THEN greatest(0, least(near.near_ord + 20, top.m)) END AS dx_ord
  FROM one LEFT JOIN near ON near.day = effective_date CROSS JOIN top),
pri AS (SELECT * FROM mst WHERE exclusion_reason = '')
"""
S_BARS = f"""
bars AS (SELECT {KEY.format('security_id')} AS security_id, s.ord, open, close, greatest(coalesce(volume, 0), 0) AS volume FROM prices p JOIN trading_sessions s ON s.session_date = p.date
  WHERE {KEY.format('security_id')} IS NOT NULL AND open > 0 AND close > 0
  QUALIFY row_number() OVER (PARTITION BY {KEY.format('security_id')}, s.ord ORDER BY ingested_at DESC, bar_id DESC) = 1)
"""
S_SUR = f"""{S_MASTER},
s0 AS (SELECT *, actual_eps - estimated_eps AS eps_surprise, actual_revenue - estimated_revenue AS rev_surprise, CASE WHEN abs(estimated_eps) > 1e-6 THEN (actual_eps - estimated_eps) / abs(estimated_eps) END AS eps_surprise_pct,
  CASE WHEN abs(estimated_revenue) > 1e-6 THEN (actual_revenue - estimated_revenue) / abs(estimated_revenue) END AS rev_surprise_pct, coalesce(CAST(actual_eps - estimated_eps > 0 AS INT), 0) AS beat FROM pri),
s1 AS (SELECT *, CASE WHEN count(eps_surprise_pct) OVER h >= 2 THEN stddev_samp(eps_surprise_pct) OVER h END AS surprise_std_hist, lag(eps_surprise_pct) OVER o AS prev_surprise_pct,
  CASE WHEN beat = lag(beat) OVER o THEN 0 ELSE 1 END AS turn
  FROM s0 WINDOW o AS (PARTITION BY security_id ORDER BY effective_date NULLS FIRST, event_id), h AS (PARTITION BY security_id ORDER BY effective_date NULLS FIRST, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s2 AS (SELECT *, sum(turn) OVER (PARTITION BY security_id ORDER BY effective_date NULLS FIRST, event_id ROWS UNBOUNDED PRECEDING) AS run FROM s1),
sur AS (SELECT *, eps_surprise_pct / nullif(surprise_std_hist, 0) AS sue, CAST(beat * sum(beat) OVER (PARTITION BY security_id, run ORDER BY effective_date NULLS FIRST, event_id ROWS UNBOUNDED PRECEDING) AS INT) AS beat_streak FROM s2)
"""
S_PRED = """
pre AS (SELECT event_type AS model, 'week_' || CAST(floor((CAST(ts AS DATE) - DATE '2024-01-01') / 7) AS BIGINT) AS fold, event_id, value AS prediction, lead(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) - value AS actual FROM events),
ok AS (SELECT * FROM pre WHERE isfinite(prediction) AND isfinite(actual))
"""


def market_sql(least: int, short: int, mid: int, long: int, vol: int, volume: int) -> str:
    return f"""{S_MASTER}, {S_BARS},
b1 AS (SELECT *, row_number() OVER o AS n, close / lag(close) OVER o - 1 AS ret, close / lag(close, {short}) OVER o - 1 AS mom_1m, close / lag(close, {mid}) OVER o - 1 AS mom_3m, close / lag(close, {long}) OVER o - 1 AS mom_6m,
  CASE WHEN row_number() OVER o >= {long} THEN close / max(close) OVER (PARTITION BY security_id ORDER BY ord ROWS {long - 1} PRECEDING) - 1 END AS dist_high,
  volume / nullif(avg(volume) OVER (PARTITION BY security_id ORDER BY ord ROWS {volume - 1} PRECEDING), 0) - 1 AS volume_surprise FROM bars WINDOW o AS (PARTITION BY security_id ORDER BY ord)),
b2 AS (SELECT *, stddev_samp(ret) OVER (PARTITION BY security_id ORDER BY ord ROWS {vol - 1} PRECEDING) AS rv_3m, sum(ret) OVER (PARTITION BY security_id ORDER BY ord ROWS 4 PRECEDING) AS short_term_reversal,
  lead(ord) OVER (PARTITION BY security_id ORDER BY ord) AS next_ord FROM b1),
neg AS (SELECT security_id, ord, stddev_samp(ret) OVER (PARTITION BY security_id ORDER BY ord ROWS {vol - 1} PRECEDING) AS fall FROM b1 WHERE ret < 0),
b3 AS (SELECT b2.*, last_value(fall IGNORE NULLS) OVER (PARTITION BY b2.security_id ORDER BY b2.ord ROWS UNBOUNDED PRECEDING) AS downside_vol_3m FROM b2 LEFT JOIN neg ON neg.security_id = b2.security_id AND neg.ord = b2.ord),
ctx AS (SELECT p.event_id, {', '.join('b3.' + c for c in features.MARKET)} FROM pri p LEFT JOIN b3 ON b3.security_id = p.security_id AND b3.ord < p.entry_ord AND (b3.next_ord >= p.entry_ord OR b3.next_ord IS NULL) AND b3.n >= {least})
"""


def master(spark: SparkSession, folder: str) -> DataFrame:
    """The event master with session ordinals."""
    return alignment.event_master(views.events(spark, folder), views.days(spark, folder), views.sessions(spark, folder))


def primary(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.primary(master(spark, folder))


# ---- calendar and alignment ----
@register("calendar_sessions", "SELECT session_date, CAST(ord AS INT) AS ord FROM trading_sessions")
def _(spark, folder):
    return cal.exchange_sessions(spark, "2023-01-03", "2026-03-31")


@register("calendar_next_prev", f"WITH {S_DIM}, {S_EV} SELECT event_id, market_date, coalesce(is_session, false) AS is_session, prev_session, next_session FROM evd LEFT JOIN dim ON dim.day = market_date")
def _(spark, folder):
    dated = views.events(spark, folder).select("event_id", cal.market_date("announcement_timestamp").alias("market_date"))
    seen = cal.with_day(dated, "market_date", views.days(spark, folder), {c: c for c in ("is_session", "prev_session", "next_session")})
    return seen.withColumn("is_session", F.coalesce("is_session", F.lit(False)))


@register(
    "calendar_shift",
    f"WITH {S_DIM}, {S_EV} SELECT event_id, a.session_date AS ahead, b.session_date AS nearest, c.session_date AS back FROM evd LEFT JOIN near ON near.day = market_date "
    "LEFT JOIN trading_sessions a ON near_ord IS NOT NULL AND a.ord = greatest(0, least(near_ord + 20, (SELECT max(ord) FROM trading_sessions))) LEFT JOIN trading_sessions b ON b.ord = near_ord "
    "LEFT JOIN trading_sessions c ON near_ord IS NOT NULL AND c.ord = greatest(0, near_ord - 20)",
)
def _(spark, folder):
    dated = views.events(spark, folder).select("event_id", cal.market_date("announcement_timestamp").alias("d"))
    targets = cal.shift_table(views.days(spark, folder), views.sessions(spark, folder), {"ahead": 20, "nearest": 0, "back": -20})
    return cal.with_day(dated, "d", targets, {c: c for c in ("ahead", "nearest", "back")}).drop("d")


@register("session_filter", "SELECT date, count(*) AS n FROM prices SEMI JOIN trading_sessions ON session_date = date GROUP BY 1")
def _(spark, folder):
    return cal.only_sessions(table(spark, folder, "prices", "date"), "date", views.sessions(spark, folder)).groupBy("date").agg(F.count(F.lit(1)).alias("n"))


@register("effective_date", f"WITH {S_EFF} SELECT event_id, timing_class, market_date, effective_date FROM eff")
def _(spark, folder):
    return alignment.effective_dates(views.events(spark, folder), views.days(spark, folder)).select("event_id", "timing_class", "market_date", "effective_date")


@register(
    "event_master_dedup",
    f"WITH {S_MASTER} SELECT event_id, security_id, fiscal_period_end, effective_date, exclusion_reason, {utc('prediction_timestamp', 'prediction_timestamp')}, {utc('order_submission_cutoff', 'order_submission_cutoff')}, a.session_date AS reaction_exit, b.session_date AS drift_exit, "
    "CASE WHEN announcement_timestamp IS NULL THEN 'missing_announcement_ts' WHEN exclusion_reason <> '' THEN 'excluded' ELSE 'ok' END AS data_quality_status "
    "FROM mst LEFT JOIN trading_sessions a ON a.ord = rx_ord LEFT JOIN trading_sessions b ON b.ord = dx_ord",
)
def _(spark, folder):
    full = alignment.event_master(views.events(spark, folder), views.days(spark, folder), views.sessions(spark, folder))
    return full.select("event_id", "security_id", "fiscal_period_end", "effective_date", "exclusion_reason", "prediction_timestamp", "order_submission_cutoff", "reaction_exit", "drift_exit", "data_quality_status")


@register(
    "alignment_report",
    f"""WITH {S_MASTER} SELECT event_id, coalesce(dim.is_session, false) AS is_session,
    CASE WHEN timing_class = 'after_market_close' THEN coalesce(effective_date > CAST(announcement_timestamp AT TIME ZONE 'UTC' AS DATE), false) ELSE true END AS amc_next_session_ok,
    CASE WHEN timing_class = 'before_market_open' THEN coalesce(effective_date = CAST(announcement_timestamp AT TIME ZONE 'UTC' AS DATE), false) ELSE true END AS bmo_same_session_ok,
    CASE WHEN timing_class IN ('intraday', 'unknown') THEN exclusion_reason <> '' ELSE true END AS excluded_ok FROM mst LEFT JOIN dim ON dim.day = effective_date""",
)
def _(spark, folder):
    return alignment.alignment_report(master(spark, folder), views.days(spark, folder))


@register("exclusion_breakdown", f"WITH {S_MASTER} SELECT exclusion_reason, count(*) AS n FROM mst GROUP BY 1")
def _(spark, folder):
    return master(spark, folder).groupBy("exclusion_reason").agg(F.count(F.lit(1)).alias("n"))


@register(
    "golden_report",
    f"""WITH {S_DIM}, g AS (SELECT a.ticker, {_time('a.announcement_timestamp').replace(' AS a.announcement_timestamp', ' AS t')}, a.timing_class, m.effective_trading_date AS e FROM announcements a JOIN event_master m ON {KEY.format('m.event_id')} = {KEY.format('a.event_id')}),
    h AS (SELECT g.*, CASE WHEN timing_class = 'before_market_open' AND dim.is_session THEN dim.day ELSE dim.next_session END AS d, row_number() OVER (PARTITION BY ticker, t) AS k
      FROM g LEFT JOIN dim ON dim.day = CAST(t AT TIME ZONE 'America/New_York' AS DATE))
    SELECT count(*) AS n, round(avg(CAST(coalesce(d = e, false) AS INT)), {DIGITS}) AS effective_date_accuracy, round(avg(CAST(coalesce(timing_class IN ('before_market_open', 'after_market_close', 'intraday', 'unknown'), false) AS INT)), {DIGITS}) AS timing_valid_rate,
      round(avg(CAST(k > 1 AS INT)), {DIGITS}) AS duplicate_rate FROM h""",
)
def _(spark, folder):
    """Effective dates of the announcements against the ones the event master names."""
    told = table(spark, folder, "announcements").select(norm_key("event_id").alias("k"), "ticker", views.dated("announcement_timestamp"), "timing_class")
    known = table(spark, folder, "event_master").select(norm_key("event_id").alias("k"), F.col("effective_trading_date").alias("expected_effective_date"))
    return alignment.golden_report(told.join(known, "k").drop("k"), views.days(spark, folder))


# ---- features ----
def surprised(spark: SparkSession, folder: str) -> DataFrame:
    return features.surprises(primary(spark, folder))


for _name, _columns in {
    "surprise": ["eps_surprise", "eps_surprise_pct", "rev_surprise", "rev_surprise_pct"],
    "sue_expanding_std": ["surprise_std_hist", "sue"],
    "beat_streak": ["beat", "beat_streak"],
    "prev_surprise": ["prev_surprise_pct"],
}.items():
    _doubles = [c for c in _columns if not c.startswith("beat")]
    _parts = ", ".join(filter(None, [r(*_doubles), ", ".join(c for c in _columns if c.startswith("beat"))]))
    register(_name, f"WITH {S_SUR} SELECT event_id, {_parts} FROM sur")(lambda spark, folder, c=_columns: surprised(spark, folder).select("event_id", *c))

#: The windows in use, and shorter ones that also fill on small data.
WINDOWS = {"": dict(least=131, short=21, mid=63, long=126, volatility=63, volume=63), "_short": dict(least=47, short=5, mid=21, long=42, volatility=21, volume=21)}


def context(spark: SparkSession, folder: str, suffix: str = "", columns: list[str] | None = None) -> DataFrame:
    return features.market_context(primary(spark, folder), views.bars(spark, folder), columns=columns, **WINDOWS[suffix])


for _suffix, _w in WINDOWS.items():
    _sql = market_sql(_w["least"], _w["short"], _w["mid"], _w["long"], _w["volatility"], _w["volume"])
    for _name, _columns in {
        "momentum_asof": ["mom_1m", "mom_3m", "mom_6m"], "rolling_high_distance": ["dist_high"], "rolling_vol": ["rv_3m"],
        "downside_vol": ["downside_vol_3m"], "volume_surprise": ["volume_surprise"], "reversal": ["short_term_reversal"],
    }.items():
        register(_name + _suffix, f"WITH {_sql} SELECT event_id, {r(*_columns)} FROM ctx")(lambda spark, folder, c=_columns, s=_suffix: context(spark, folder, s, c))


@register("surprise_zscore", f"WITH {S_SUR}, z AS (SELECT avg(eps_surprise_pct) AS m, stddev_pop(eps_surprise_pct) AS s FROM sur) SELECT event_id, round((eps_surprise_pct - m) / (s + 1e-9), {DIGITS}) AS z FROM sur CROSS JOIN z")
def _(spark, folder):
    return features.standardize(surprised(spark, folder).select("event_id", "eps_surprise_pct"), "eps_surprise_pct", "z").select("event_id", "z")


S_MATRIX = market_sql(*WINDOWS["_short"].values()) + S_SUR.removeprefix(S_MASTER).rstrip() + f""",
liq AS (SELECT event_id, row_number() OVER (PARTITION BY fiscal_year ORDER BY market_cap_at_event NULLS FIRST, event_id) AS k, count(*) OVER (PARTITION BY fiscal_year) AS n FROM pri),
mat AS (SELECT sur.*, {', '.join('ctx.' + c for c in features.MARKET)}, CASE WHEN n > 1 THEN CAST(least(3, 1 + ((k - 1) * 3) // (n - 1)) AS INT) END AS liquidity_bucket FROM sur LEFT JOIN ctx USING (event_id) LEFT JOIN liq USING (event_id))
"""
MATRIX = [c for c in models.NUMERIC if not c.startswith("beat")]


def matrix(spark: SparkSession, folder: str) -> DataFrame:
    """Surprises, market context and liquidity bucket of each primary event."""
    full = surprised(spark, folder).join(context(spark, folder, "_short"), "event_id", "left")
    return ranks.bucketed(full, ["fiscal_year"], "market_cap_at_event", "event_id", 3, "liquidity_bucket")


@register("feature_matrix", f"WITH {S_MATRIX} SELECT event_id, {r(*[c for c in MATRIX if c != 'market_cap_at_event'])}, market_cap_at_event, beat, beat_streak, liquidity_bucket FROM mat")
def _(spark, folder):
    return matrix(spark, folder).select("event_id", *MATRIX, "beat", "beat_streak", "liquidity_bucket")


@register(
    "liquidity_tercile",
    f"""WITH {S_MASTER}, k AS (SELECT event_id, fiscal_year, row_number() OVER (PARTITION BY fiscal_year ORDER BY market_cap_at_event NULLS FIRST, event_id) AS k, count(*) OVER (PARTITION BY fiscal_year) AS n FROM pri)
    SELECT event_id, fiscal_year, CASE WHEN n > 1 THEN CAST(least(3, 1 + ((k - 1) * 3) // (n - 1)) AS INT) END AS bucket FROM k""",
)
def _(spark, folder):
    rows = primary(spark, folder).select("event_id", "fiscal_year", "market_cap_at_event")
    return ranks.bucketed(rows, ["fiscal_year"], "market_cap_at_event", "event_id", 3).drop("market_cap_at_event")


@register(
    "merge_availability",
    f"""WITH {S_MASTER} SELECT event_id, {utc('estimate_timestamp', 'source_available_at')}, {utc("greatest(announcement_timestamp, (dim.prev_session + INTERVAL 16 HOUR + INTERVAL 5 MINUTE) AT TIME ZONE 'America/New_York', effective_date::TIMESTAMP AT TIME ZONE 'America/New_York')", 'feature_available_at')} FROM pri LEFT JOIN dim ON dim.day = effective_date""",
)
def _(spark, folder):
    rows = cal.with_day(primary(spark, folder), "effective_date", views.days(spark, folder), {"prev_session": "_prev"})
    parts = rows.withColumns({"_market": cal.at_clock("_prev", 16, 5), "_cross": cal.at_clock("effective_date", 0, 0)})
    return parts.select("event_id", F.col("estimate_timestamp").alias("source_available_at"), features.latest_availability(["announcement_timestamp", "_market", "_cross"]).alias("feature_available_at"))


# ---- labels ----
S_LAB = f"""{S_MASTER}, {S_BARS},
mk AS (SELECT ord, avg(open) AS o, avg(close) AS c FROM bars GROUP BY 1),
sx AS (SELECT sector, b.ord, avg(open) AS o, avg(close) AS c FROM bars b JOIN (SELECT security_id, max(sector) AS sector FROM ev GROUP BY 1) USING (security_id) WHERE sector IS NOT NULL GROUP BY 1, 2),
l0 AS (SELECT p.event_id, e.close / e.open - 1 AS rea, d.close / x.close - 1 AS dri, e.ord IS NOT NULL AND x.ord IS NOT NULL AND d.ord IS NOT NULL AS whole,
  coalesce(me.c / me.o - 1, 0) AS mr, coalesce(md.c / mx.c - 1, 0) AS md, coalesce(se.c / se.o - 1, 0) AS sr, coalesce(sd.c / ss.c - 1, 0) AS sd
  FROM pri p LEFT JOIN bars e ON e.security_id = p.security_id AND e.ord = entry_ord LEFT JOIN bars x ON x.security_id = p.security_id AND x.ord = rx_ord LEFT JOIN bars d ON d.security_id = p.security_id AND d.ord = dx_ord
  LEFT JOIN mk me ON me.ord = entry_ord LEFT JOIN mk mx ON mx.ord = rx_ord LEFT JOIN mk md ON md.ord = dx_ord
  LEFT JOIN sx se ON se.sector = p.sector AND se.ord = entry_ord LEFT JOIN sx ss ON ss.sector = p.sector AND ss.ord = rx_ord LEFT JOIN sx sd ON sd.sector = p.sector AND sd.ord = dx_ord),
lab AS (SELECT event_id, CASE WHEN whole THEN rea END AS reaction_car, CASE WHEN whole THEN rea - mr END AS reaction_car_market_adj, CASE WHEN whole THEN rea - sr END AS reaction_car_sector_adj,
  CASE WHEN whole THEN dri END AS drift_car_20, CASE WHEN whole THEN dri - md END AS drift_car_20_market_adj, CASE WHEN whole THEN dri - sd END AS drift_car_20_sector_adj FROM l0)
"""
LABELS = [f"{a}{b}" for a in ("reaction_car", "drift_car_20") for b in ("", "_market_adj", "_sector_adj")]


def labelled(spark: SparkSession, folder: str) -> DataFrame:
    bars = views.bars(spark, folder)
    sector = views.events(spark, folder).groupBy("security_id").agg(F.max("sector").alias("sector")).where("sector is not null")
    return labels.return_labels(primary(spark, folder), bars, labels.average_bars(bars, []), labels.average_bars(bars.join(sector, "security_id"), ["sector"]))


register("reaction_drift_labels", f"WITH {S_LAB} SELECT event_id, {r(*LABELS)} FROM lab")(labelled)


@register(
    "realized_vol_range",
    f"""WITH {S_MASTER}, {S_BARS}, m AS (SELECT p.event_id, ln(close) - ln(lag(close) OVER (PARTITION BY p.event_id ORDER BY ord)) AS mv FROM pri p JOIN bars b ON b.security_id = p.security_id AND ord > entry_ord AND ord <= dx_ord),
    v AS (SELECT event_id, CASE WHEN count(*) >= 5 THEN stddev_samp(mv) END AS realized_vol_20 FROM m GROUP BY 1)
    SELECT pri.event_id, {r('realized_vol_20')}, round(realized_vol_20 * sqrt(252), {DIGITS}) AS realized_vol_20_annualized FROM pri LEFT JOIN v USING (event_id)""",
)
def _(spark, folder):
    return labels.realized_volatility(primary(spark, folder), views.bars(spark, folder))


@register("winsorize", f"WITH {S_SUR}, q AS (SELECT quantile_cont(eps_surprise_pct, 0.005) AS a, quantile_cont(eps_surprise_pct, 0.995) AS b FROM sur) SELECT event_id, round(CASE WHEN eps_surprise_pct IS NULL THEN NULL ELSE greatest(least(eps_surprise_pct, b), a) END, {DIGITS}) AS eps_surprise_pct FROM sur CROSS JOIN q")
def _(spark, folder):
    return features.winsorize(surprised(spark, folder).select("event_id", "eps_surprise_pct"), "eps_surprise_pct")


@register(
    "latent_override",
    f"""WITH {S_LAB}, x AS (SELECT lab.event_id, surprise_pct / 100 AS r, beta / 100 AS d, annual_vol / sqrt(252) AS v FROM lab LEFT JOIN announcements a ON a.event_id = lab.event_id)
    SELECT event_id, {', '.join(f'round({c}, {DIGITS}) AS {n}' for c, ns in (('r', LABELS[:3]), ('d', LABELS[3:]), ('v', ['realized_vol_20']), ('v * sqrt(252)', ['realized_vol_20_annualized'])) for n in ns)} FROM x""",
)
def _(spark, folder):
    """All eight labels replaced; the announcements' own surprise, beta and volatility stand in for planted values."""
    planted = table(spark, folder, "announcements").select("event_id", (F.col("surprise_pct") / 100).alias("planted_reaction"), (F.col("beta") / 100).alias("planted_drift"), (F.col("annual_vol") / 252**0.5).alias("planted_volatility"))
    full = labelled(spark, folder).join(labels.realized_volatility(primary(spark, folder), views.bars(spark, folder)), "event_id")
    return labels.override_planted(full, planted)


S_RET = f"""{S_MASTER}, {S_BARS}, ret AS (SELECT p.event_id, x.close / e.open - 1 AS gross_reaction, d.close / e.open - 1 AS gross_drift FROM pri p LEFT JOIN bars e ON e.security_id = p.security_id AND e.ord = entry_ord
  LEFT JOIN bars x ON x.security_id = p.security_id AND x.ord = rx_ord LEFT JOIN bars d ON d.security_id = p.security_id AND d.ord = dx_ord)"""


@register("training_matrix", f"WITH {S_MATRIX}{S_LAB.removeprefix(S_MASTER).replace(f', {S_BARS},', ',', 1).rstrip()} SELECT event_id, {r('eps_surprise_pct', 'mom_1m', 'reaction_car', 'drift_car_20')}, market_cap_at_event FROM mat JOIN lab USING (event_id) WHERE reaction_car IS NOT NULL")
def _(spark, folder):
    """Features met with labels, as models are trained on them."""
    made = labelled(spark, folder).where("reaction_car is not null")
    return matrix(spark, folder).join(made, "event_id").select("event_id", "eps_surprise_pct", "mom_1m", "market_cap_at_event", "reaction_car", "drift_car_20")


@register("tradable_returns", f"WITH {S_RET} SELECT event_id, {r('gross_reaction', 'gross_drift')} FROM ret")
def _(spark, folder):
    return labels.tradable_returns(primary(spark, folder), views.bars(spark, folder))


@register(
    "security_asof",
    f"""WITH v AS (SELECT {KEY.format('security_id')} AS security_id, version_id, sector, valid_at, recorded_at FROM security_master WHERE valid_at <= DATE '2024-06-28' AND (delisting_date IS NULL OR delisting_date > DATE '2024-06-28') AND deleted_at IS NULL)
    SELECT security_id, version_id, sector FROM v WHERE security_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY security_id ORDER BY valid_at DESC, recorded_at DESC, version_id) = 1""",
)
def _(spark, folder):
    day = F.lit("2024-06-28").cast("date")
    rows = table(spark, folder, "security_master").withColumn("security_id", norm_key("security_id")).where("deleted_at is null")
    return securities.latest_versions(rows, day, ["version_id", "sector"])


@register(
    "security_versions",
    f"SELECT version_id, {KEY.format('security_id')} AS security_id, CASE WHEN market_cap_usd >= 1e10 THEN 'large_cap' WHEN market_cap_usd >= 2e9 THEN 'mid_cap' WHEN market_cap_usd IS NOT NULL THEN 'small_cap' END AS bucket "
    f"FROM security_master WHERE {KEY.format('security_id')} IS NOT NULL AND valid_at <= DATE '2024-06-28' AND (delisting_date IS NULL OR delisting_date > DATE '2024-06-28')",
)
def _(spark, folder):
    rows = table(spark, folder, "security_master").withColumn("security_id", norm_key("security_id"))
    return securities.valid_versions(rows, F.lit("2024-06-28").cast("date")).select("version_id", "security_id", securities.cap_bucket("market_cap_usd").alias("bucket"))


@register(
    "pit_violations",
    f"""WITH {S_EV}, f AS (SELECT feature_id, {KEY.format('f.event_id')} AS k, f.feature_available_at, f.prediction_timestamp, m.order_submission_cutoff FROM features f JOIN event_master m ON {KEY.format('m.event_id')} = {KEY.format('f.event_id')})
    SELECT 'late_feature' AS rule, count(*) AS violations FROM f WHERE feature_available_at >= order_submission_cutoff
    UNION ALL SELECT 'late_feature_loose', count(*) FROM f WHERE feature_available_at > prediction_timestamp
    UNION ALL SELECT 'late_estimate', count(*) FROM ev WHERE estimate_timestamp >= announcement_timestamp
    UNION ALL SELECT 'late_filing', count(*) FROM f JOIN ev ON ev.event_id = f.k WHERE filing_timestamp >= f.prediction_timestamp
    UNION ALL SELECT 'labelled_too_late', count(*) FROM f SEMI JOIN ev ON ev.event_id = f.k WHERE feature_available_at >= prediction_timestamp""",
)
def _(spark, folder):
    cut = table(spark, folder, "event_master").select(norm_key("event_id").alias("event_id"), "order_submission_cutoff")
    rows = table(spark, folder, "features", "event_id", "feature_available_at", "prediction_timestamp").withColumn("event_id", norm_key("event_id")).join(cut, "event_id")
    told = views.events(spark, folder)
    rules = {"late_feature": integrity.late_features(rows), "late_feature_loose": integrity.late_features(rows, False), "late_estimate": integrity.late_estimates(told), "late_filing": integrity.late_filings(rows, told), "labelled_too_late": integrity.labelled_too_late(rows, told)}
    counts = [df.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(rule).alias("rule"), "violations") for rule, df in rules.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


@register(
    "violation_sample",
    f"""SELECT feature_id, {utc('f.feature_available_at', 'feature_available_at')}, {utc('m.order_submission_cutoff', 'order_submission_cutoff')} FROM features f JOIN event_master m ON {KEY.format('m.event_id')} = {KEY.format('f.event_id')}
    WHERE f.feature_available_at >= m.order_submission_cutoff ORDER BY feature_id, 3 LIMIT 5""",
)
def _(spark, folder):
    """The first five late features, as a report shows them; ``pit_violations`` counts all."""
    cut = table(spark, folder, "event_master").select(norm_key("event_id").alias("event_id"), "order_submission_cutoff")
    rows = table(spark, folder, "features", "feature_id", "event_id", "feature_available_at").withColumn("event_id", norm_key("event_id")).join(cut, "event_id")
    return integrity.late_features(rows).select("feature_id", "feature_available_at", "order_submission_cutoff").orderBy("feature_id", "order_submission_cutoff").limit(5)


CONTRACT = integrity.Contract(
    T.StructType([T.StructField("event_id", T.StringType(), False), T.StructField("security_id", T.StringType(), False), T.StructField("timing_class", T.StringType()), T.StructField("announcement_timestamp", T.TimestampType(), False), T.StructField("source", T.StringType(), False)]),
    {"timing_class": ["before_market_open", "after_market_close"], "cap_bucket": ["large_cap", "mid_cap", "small_cap"]},
    ("security_id", "fiscal_period_end"),
)


@register(
    "contracts_report",
    """SELECT 'not_null' AS rule, 'event_id' AS "column", count(*) FILTER (WHERE event_id IS NULL) AS violations FROM announcements
    UNION ALL SELECT 'not_null', 'security_id', count(*) FILTER (WHERE security_id IS NULL) FROM announcements
    UNION ALL SELECT 'not_null', 'announcement_timestamp', count(*) FILTER (WHERE announcement_timestamp IS NULL) FROM announcements
    UNION ALL SELECT 'not_null', 'source', count(*) FILTER (WHERE source IS NULL) FROM announcements
    UNION ALL SELECT 'allowed', 'timing_class', count(*) FILTER (WHERE timing_class NOT IN ('before_market_open', 'after_market_close')) FROM announcements
    UNION ALL SELECT 'allowed', 'cap_bucket', count(*) FILTER (WHERE cap_bucket NOT IN ('large_cap', 'mid_cap', 'small_cap')) FROM announcements
    UNION ALL SELECT 'unique', 'security_id,fiscal_period_end', CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM announcements GROUP BY security_id, fiscal_period_end)""",
)
def _(spark, folder):
    return integrity.contract_report(table(spark, folder, "announcements"), CONTRACT)


def _contract_sql() -> str:
    """Null counts and values outside the allowed ones of the seven tables, which have all columns."""
    sources = {"events": "announcements", "prices": "prices", "estimates": "estimates", "filings": "filings", "event_master": "event_master", "features": "features", "labels": "lab8"}
    parts = []
    for name, contract in contracts.CONTRACTS.items():
        for f in contract.columns:
            if not f.nullable:
                parts.append(f"SELECT '{name}' AS table_name, 'not_null' AS rule, '{f.name}' AS \"column\", count(*) FILTER (WHERE {f.name} IS NULL) AS violations FROM {sources[name]}")
        for c, values in contract.allowed.items():
            parts.append(f"SELECT '{name}', 'allowed', '{c}', count(*) FILTER (WHERE {c} NOT IN {_in(values)}) FROM {sources[name]}")
    return f"WITH {S_MASTER}, lab8 AS (SELECT event_id FROM pri) " + " UNION ALL ".join(parts)


def _in(words: list[str]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


@register("contracts_all", _contract_sql())
def _(spark, folder):
    """The contracts of all seven tables, against the stored tables and the labels made from them."""
    stored = {"events": "announcements"} | {n: n for n in ("prices", "estimates", "filings", "event_master", "features")}
    made = labelled(spark, folder).join(labels.realized_volatility(primary(spark, folder), views.bars(spark, folder)), "event_id")
    return contracts.table_report({name: table(spark, folder, source) for name, source in stored.items()} | {"labels": made})


# ---- text ----
TONE_LISTS = {"pos_freq": tone.POSITIVE, "neg_freq": tone.NEGATIVE, "uncertainty_freq": tone.UNCERTAINTY, "litigation_freq": tone.LITIGATION}
S_TONE = (
    """t AS (SELECT filing_id, event_id, security_id, filing_timestamp, coalesce(text, '') AS x, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\\s+'), lambda w: w <> '') AS t FROM filings),
ts AS (SELECT *, length(x)::DOUBLE AS n_chars, len(t)::DOUBLE AS n_tokens, len(list_filter(t, lambda w: regexp_matches(w, '[0-9]'))) / greatest(1, len(t))::DOUBLE AS numerical_density, """
    + ", ".join(f"len(list_filter(t, lambda w: w IN {_in(words)})) / greatest(1, len(t))::DOUBLE AS {name}" for name, words in TONE_LISTS.items())
    + " FROM t)"
)


@register("tone_scores", f"WITH {S_TONE} SELECT filing_id, {r('n_chars', 'n_tokens', 'numerical_density', *TONE_LISTS)}, round(pos_freq - neg_freq, {DIGITS}) AS tone_net FROM ts")
def _(spark, folder):
    return tone.tone_scores(table(spark, folder, "filings", "filing_id", "text"), "text").drop("text")


@register(
    "delta_tone",
    f"""WITH {S_MASTER}, {S_TONE}, j AS (SELECT ts.filing_id, pri.security_id, ts.filing_timestamp, pos_freq - neg_freq AS tone_net FROM ts JOIN pri ON pri.event_id = {KEY.format('ts.event_id')} AND ts.filing_timestamp < pri.order_submission_cutoff),
    k AS (SELECT *, lag(tone_net) OVER (PARTITION BY security_id ORDER BY filing_timestamp, filing_id) AS tone_net_prev FROM j)
    SELECT filing_id, {r('tone_net', 'tone_net_prev')}, round(tone_net - tone_net_prev, {DIGITS}) AS delta_tone FROM k""",
)
def _(spark, folder):
    told = primary(spark, folder).select("event_id", "security_id", "order_submission_cutoff")
    filed = table(spark, folder, "filings", "filing_id", "event_id", "filing_timestamp", "text").withColumn("event_id", norm_key("event_id"))
    known = told.join(filed, "event_id").where("filing_timestamp < order_submission_cutoff")
    return tone.tone_changes(tone.tone_scores(known, "text"), "security_id", "filing_timestamp", "filing_id").select("filing_id", "tone_net", "tone_net_prev", "delta_tone")


# ---- walk-forward ----
FOLDS = ("2023-01-01", "2023-06-30", "2023-07-01", "2023-12-31", "2024-01-01", "2025-12-31")
S_FOLDS = """
fo AS (SELECT * FROM (VALUES ('test_2024', DATE '2023-01-01', DATE '2023-06-30', DATE '2023-07-01', DATE '2023-12-31', DATE '2024-01-01', DATE '2024-12-31'),
  ('test_2025', DATE '2023-01-01', DATE '2023-12-31', DATE '2024-01-01', DATE '2024-12-31', DATE '2025-01-01', DATE '2025-12-31')) v(fold, a, b, c, d, e, f))
"""
S_MEM = f"""{S_SUR}, {S_FOLDS}, mem AS (SELECT sur.*, fold, 'train' AS role FROM sur JOIN fo ON effective_date BETWEEN a AND b UNION ALL SELECT sur.*, fold, 'val' FROM sur JOIN fo ON effective_date BETWEEN c AND d
UNION ALL SELECT sur.*, fold, 'test' FROM sur JOIN fo ON effective_date BETWEEN e AND f)"""


def members(spark: SparkSession, folder: str) -> DataFrame:
    return evaluation.fold_members(surprised(spark, folder), "effective_date", evaluation.make_folds(spark, *FOLDS))


@register("folds_membership", f"WITH {S_MEM} SELECT event_id, fold, role FROM mem")
def _(spark, folder):
    return members(spark, folder).select("event_id", "fold", "role")


_fit = f"{S_MEM}, fit AS (SELECT fold, avg(rev_surprise_pct) AS mean, avg(eps_surprise_pct) AS x, quantile_cont(eps_surprise_pct, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS cuts FROM mem WHERE role = 'train' GROUP BY 1), sec AS (SELECT fold, sector, avg(eps_surprise_pct) AS sx FROM mem WHERE role = 'train' AND sector IS NOT NULL GROUP BY 1, 2)"
for _name, _expr in {
    "unconditional_mean": "fit.mean", "event_day_unconditional": "fit.mean", "surprise": "coalesce(eps_surprise_pct, 0)", "prior": "coalesce(prev_surprise_pct, 0)",
    "surprise_decile": "CASE WHEN eps_surprise_pct IS NULL THEN 0 ELSE len(list_filter(fit.cuts, lambda c: c <= eps_surprise_pct)) / 10.0 END",
    "sector_relative": "coalesce(eps_surprise_pct - coalesce(sx, fit.x), 0)",
}.items():
    register(f"baseline_{_name}", f"WITH {_fit} SELECT mem.fold, event_id, round(CAST({_expr} AS DOUBLE), {DIGITS}) AS prediction, round(rev_surprise_pct, {DIGITS}) AS actual FROM mem JOIN fit ON fit.fold = mem.fold LEFT JOIN sec ON sec.fold = mem.fold AND sec.sector = mem.sector WHERE role = 'test'")(
        lambda spark, folder, m=_name: evaluation.baseline_predictions(members(spark, folder), "rev_surprise_pct", m)
    )


# ---- metrics ----
def metric_sql(by: str) -> str:
    return f"""{S_PRED},
k AS (SELECT *, rank() OVER (PARTITION BY {by} ORDER BY prediction) + (count(*) OVER (PARTITION BY {by}, prediction) - 1) / 2.0 AS rp, rank() OVER (PARTITION BY {by} ORDER BY actual) + (count(*) OVER (PARTITION BY {by}, actual) - 1) / 2.0 AS ra,
  CAST(actual > 0 AS INT) AS y, 1 / (1 + exp(-prediction)) AS pr FROM ok),
c AS (SELECT {by}, count(*) AS n, avg(abs(prediction - actual)) AS mae, sqrt(avg((prediction - actual) ** 2)) AS rmse, corr(prediction, actual) AS pearson, corr(rp, ra) AS spearman, quantile_cont(prediction, 0.2) AS q1, quantile_cont(prediction, 0.8) AS q2,
  (sum(rp) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2.0) / nullif(sum(y) * (count(*) - sum(y)), 0) AS roc_auc, avg((pr - y) ** 2) AS brier FROM k GROUP BY ALL),
s AS (SELECT {', '.join('k.' + x.strip() for x in by.split(','))}, avg(k.actual) FILTER (WHERE k.prediction >= q2) - avg(k.actual) FILTER (WHERE k.prediction <= q1) AS top_minus_bottom FROM k JOIN c USING ({by}) GROUP BY ALL),
b AS (SELECT {by}, least(9, floor(pr * 10)) AS bin, count(*) AS nb, avg(pr) AS p, avg(y) AS m FROM k GROUP BY ALL), e AS (SELECT {by}, sum(nb * abs(p - m)) / sum(nb) AS ece FROM b GROUP BY ALL),
met AS (SELECT {by}, n, CASE WHEN n >= 5 THEN mae END AS mae, CASE WHEN n >= 5 THEN rmse END AS rmse, CASE WHEN n >= 5 AND isfinite(pearson) THEN pearson END AS pearson, CASE WHEN n >= 5 AND isfinite(spearman) THEN spearman END AS spearman,
  CASE WHEN n >= 10 THEN top_minus_bottom END AS top_minus_bottom, CASE WHEN n >= 5 AND roc_auc IS NOT NULL AND isfinite(pearson) THEN roc_auc END AS roc_auc, CASE WHEN n >= 5 AND roc_auc IS NOT NULL AND isfinite(pearson) THEN brier END AS brier,
  CASE WHEN n >= 5 AND roc_auc IS NOT NULL AND isfinite(pearson) THEN ece END AS ece FROM c JOIN s USING ({by}) JOIN e USING ({by}))"""


METRICS = ["mae", "rmse", "pearson", "spearman", "top_minus_bottom", "roc_auc", "brier", "ece"]
for _name, _columns in {"fold_metrics": METRICS, "spearman": ["spearman"], "roc_auc": ["roc_auc"], "ece": ["ece", "brier"], "top_minus_bottom": ["top_minus_bottom"]}.items():
    register(_name, f"WITH {metric_sql('model, fold')} SELECT model, fold, n, {r(*_columns)} FROM met")(lambda spark, folder, c=_columns: evaluation.group_metrics(views.predictions(spark, folder), ["model", "fold"]).select("model", "fold", "n", *c))


@register("pooled_metrics", f"WITH {metric_sql('model')}, a AS (SELECT model, count(*) AS n_total, avg(actual) / (coalesce(stddev_samp(actual), 0) + 1e-9) AS effect_size FROM pre GROUP BY 1) SELECT model, n_total, n, {r('effect_size', *METRICS)} FROM a LEFT JOIN met USING (model)")
def _(spark, folder):
    return evaluation.pooled_metrics(views.predictions(spark, folder))


@register("bootstrap_ci")
def _(spark, folder):
    return evaluation.block_bootstrap(views.predictions(spark, folder), ["model"], ["fold", "event_id"])


S_BUCKET = f"{S_PRED}, bk AS (SELECT *, row_number() OVER (PARTITION BY model, fold ORDER BY prediction, event_id) AS k, count(*) OVER (PARTITION BY model, fold) AS n FROM ok), q AS (SELECT *, CASE WHEN n > 1 THEN CAST(greatest(1, ((k - 1) * 5 + n - 2) // (n - 1)) AS INT) END AS bucket FROM bk)"


@register("fold_quantiles", f"WITH {S_BUCKET} SELECT model, fold, event_id, bucket FROM q")
def _(spark, folder):
    return evaluation.fold_buckets(evaluation.usable(views.predictions(spark, folder))).select("model", "fold", "event_id", "bucket")


#: Levels of the deduction: 0, 5, 10, 20, 30 and 50 hundredths of a percent (fixed values).
COSTS = [0.0, 0.0005, 0.001, 0.002, 0.003, 0.005]


@register(
    "scenario_sweep",
    f"""WITH {S_BUCKET}, l AS (SELECT unnest({COSTS})::DOUBLE AS level) SELECT level, count(*) FILTER (WHERE bucket = 5) AS n_top, count(*) FILTER (WHERE bucket = 1) AS n_bottom, round(avg(actual) FILTER (WHERE bucket = 5), {DIGITS}) AS top_gross,
    round(avg(actual - level) FILTER (WHERE bucket = 5), {DIGITS}) AS top_net, round(avg(-actual - level) FILTER (WHERE bucket = 1), {DIGITS}) AS bottom_net, round(avg(actual - level) FILTER (WHERE bucket = 5) + avg(-actual - level) FILTER (WHERE bucket = 1), {DIGITS}) AS spread_net
    FROM q CROSS JOIN l WHERE bucket IN (1, 5) GROUP BY 1""",
)
def _(spark, folder):
    return evaluation.scenario_sweep(evaluation.fold_buckets(evaluation.usable(views.predictions(spark, folder))), "actual", "bucket", 5, COSTS)


@register(
    "bucket_by_period",
    f"""WITH {S_BUCKET} SELECT model, fold, count(*) AS n, round(avg(actual - 0.002) * 4, {DIGITS}) AS annualized, round(stddev_samp(actual - 0.002) * 2, {DIGITS}) AS volatility, round(avg(CAST(actual - 0.002 > 0 AS INT)), {DIGITS}) AS hit_rate,
    round(avg(actual - 0.002) * 4 / nullif(stddev_samp(actual - 0.002) * 2, 0), {DIGITS}) AS ratio FROM q WHERE bucket = 5 GROUP BY 1, 2""",
)
def _(spark, folder):
    return evaluation.bucket_summary(evaluation.fold_buckets(evaluation.usable(views.predictions(spark, folder))), "actual", "bucket", 5, 0.002, ["model", "fold"])


S_BOOK = f"""{_fit}, {S_BARS}, bret AS (SELECT p.event_id, x.close / e.open - 1 AS reaction, d.close / e.open - 1 AS drift FROM pri p JOIN bars e ON e.security_id = p.security_id AND e.ord = entry_ord
  LEFT JOIN bars x ON x.security_id = p.security_id AND x.ord = rx_ord LEFT JOIN bars d ON d.security_id = p.security_id AND d.ord = dx_ord),
pos AS (SELECT 'reaction' AS horizon, mem.fold, event_id, coalesce(eps_surprise_pct, 0) AS prediction, reaction AS gross FROM mem JOIN fit ON fit.fold = mem.fold JOIN bret USING (event_id) WHERE role = 'test' AND reaction IS NOT NULL
  UNION ALL SELECT 'drift', mem.fold, event_id, coalesce(eps_surprise_pct, 0), drift FROM mem JOIN fit ON fit.fold = mem.fold JOIN bret USING (event_id) WHERE role = 'test' AND drift IS NOT NULL),
bkt AS (SELECT *, row_number() OVER (PARTITION BY horizon, fold ORDER BY prediction, event_id) AS k, count(*) OVER (PARTITION BY horizon, fold) AS n FROM pos),
book AS (SELECT *, CASE WHEN n > 1 THEN CAST(greatest(1, ((k - 1) * 5 + n - 2) // (n - 1)) AS INT) END AS bucket FROM bkt)"""


def book(spark: SparkSession, folder: str) -> DataFrame:
    """The surprise baseline's positions at both horizons."""
    events = primary(spark, folder)
    told = evaluation.baseline_predictions(members(spark, folder), "rev_surprise_pct", "surprise").withColumn("model", F.lit("surprise"))
    return evaluation.positions(events, labels.tradable_returns(events, views.bars(spark, folder)), told, {"reaction": "gross_reaction", "drift": "gross_drift"})


@register(
    "backtest_sweep",
    f"""WITH {S_BOOK}, l AS (SELECT unnest({COSTS})::DOUBLE AS level) SELECT horizon, level, count(*) FILTER (WHERE bucket = 5) AS n_top, count(*) FILTER (WHERE bucket = 1) AS n_bottom, round(avg(gross) FILTER (WHERE bucket = 5), {DIGITS}) AS top_gross,
    round(avg(gross - level) FILTER (WHERE bucket = 5), {DIGITS}) AS top_net, round(avg(-gross - level) FILTER (WHERE bucket = 1), {DIGITS}) AS bottom_net, round(avg(gross - level) FILTER (WHERE bucket = 5) + avg(-gross - level) FILTER (WHERE bucket = 1), {DIGITS}) AS spread_net
    FROM book CROSS JOIN l WHERE bucket IN (1, 5) GROUP BY ALL""",
)
def _(spark, folder):
    return evaluation.scenario_sweep(book(spark, folder), "gross", "bucket", 5, COSTS, ["horizon"])


@register(
    "backtest_primary",
    f"""WITH {S_BOOK}, s AS (SELECT horizon, count(*) FILTER (WHERE bucket = 5) AS n_top, count(*) FILTER (WHERE bucket = 1) AS n_bottom, avg(gross - 0.002) FILTER (WHERE bucket = 5) * 4 AS annualized, stddev_samp(gross - 0.002) FILTER (WHERE bucket = 5) * 2 AS volatility,
    avg(CAST(gross - 0.002 > 0 AS INT)) FILTER (WHERE bucket = 5) AS hit_rate, (avg(gross - 0.002) FILTER (WHERE bucket = 5) + avg(-gross - 0.002) FILTER (WHERE bucket = 1)) * 4 AS spread_annualized FROM book GROUP BY 1)
    SELECT horizon, n_top, n_bottom, {r('annualized', 'volatility', 'hit_rate', 'spread_annualized')}, round(annualized / nullif(volatility, 0), {DIGITS}) AS ratio, CASE WHEN n_top > 0 THEN 1.0::DOUBLE END AS turnover FROM s""",
)
def _(spark, folder):
    return evaluation.book_summary(book(spark, folder), 5, 0.002, ["horizon"])


@register("backtest_by_year", f"WITH {S_BOOK} SELECT horizon, CAST(year(fo.e) AS INT) AS year, count(*) AS n, round(avg(gross - 0.002), {DIGITS}) AS mean_net FROM book JOIN fo USING (fold) WHERE bucket = 5 GROUP BY 1, 2")
def _(spark, folder):
    return evaluation.book_by_year(book(spark, folder), evaluation.make_folds(spark, *FOLDS), 5, 0.002, ["horizon"])


@register("decay_best_model", f"WITH {metric_sql('model, fold')}, m AS (SELECT model, avg(pearson) AS p FROM met WHERE pearson IS NOT NULL GROUP BY 1), bst AS (SELECT model FROM m ORDER BY p DESC, model DESC LIMIT 1) SELECT model, fold, {r('pearson')} FROM met SEMI JOIN bst USING (model)")
def _(spark, folder):
    return evaluation.decay_of_best(evaluation.group_metrics(views.predictions(spark, folder), ["model", "fold"]))


@register(
    "ablation_subsets",
    f"""WITH {S_SUR} SELECT 'exclude_2024' AS subset, count(*) AS n, round(avg(eps_surprise_pct), {DIGITS}) AS mean_surprise FROM sur WHERE year(effective_date) <> 2024
    UNION ALL SELECT cap_bucket, count(*), round(avg(eps_surprise_pct), {DIGITS}) FROM sur WHERE cap_bucket IN ('large_cap', 'mid_cap', 'small_cap') GROUP BY 1""",
)
def _(spark, folder):
    rows = surprised(spark, folder)
    summary = [F.count(F.lit(1)).alias("n"), F.avg("eps_surprise_pct").alias("mean_surprise")]
    without = rows.where(F.year("effective_date") != 2024).agg(*summary).select(F.lit("exclude_2024").alias("subset"), "n", "mean_surprise")
    caps = rows.where(F.col("cap_bucket").isin("large_cap", "mid_cap", "small_cap")).groupBy(F.col("cap_bucket").alias("subset")).agg(*summary)
    return without.unionByName(caps)


# ---- trained models: no SQL; their tests hold them against planted signals ----
def modelled(spark: SparkSession, folder: str, model: models.Trained) -> DataFrame:
    rows = surprised(spark, folder).join(context(spark, folder, "_short"), "event_id", "left")
    wanted = evaluation.fold_members(rows, "effective_date", evaluation.make_folds(spark, *FOLDS))
    got, failed = models.walk_forward(wanted, "rev_surprise_pct", [model], [c for c in models.NUMERIC if c != "rev_surprise_pct"])
    if failed:
        raise RuntimeError(f"not fitted: {failed}")
    return got


for _model in models.standard_models():
    register(f"model_{_model.name}")(lambda spark, folder, m=_model: modelled(spark, folder, m))


# ---- streams over the event table ----
def streamed(spark: SparkSession, folder: str, plan: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Appends what is final: windows the watermark (a day behind the latest stamp) has passed."""
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    rows = stream.read_folder(spark, folder, "events.parquet", schema).withColumn("ts", F.col("ts").cast("timestamp"))
    return stream.run_available(plan(rows), f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}")


_final = "(SELECT max(ts) FROM events) - INTERVAL 1 DAY"


@register(
    "stream_tumbling",
    f"""SELECT strftime(w, '%Y-%m-%dT%H:%M:%SZ') AS start, strftime(w + INTERVAL 1 DAY, '%Y-%m-%dT%H:%M:%SZ') AS "end", event_type, count(*) AS n, round(sum(value), {DIGITS}) AS total
    FROM (SELECT *, time_bucket(INTERVAL 1 DAY, ts) AS w FROM events) WHERE w + INTERVAL 1 DAY <= {_final} GROUP BY ALL""",
)
def _(spark, folder):
    return streamed(spark, folder, lambda s: stream.windowed_activity(s, "ts", "event_type", "value", "1 day"))


@register(
    "stream_sliding",
    f"""SELECT strftime(w, '%Y-%m-%dT%H:%M:%SZ') AS start, strftime(w + INTERVAL 2 DAY, '%Y-%m-%dT%H:%M:%SZ') AS "end", event_type, count(*) AS n, round(sum(value), {DIGITS}) AS total
    FROM (SELECT *, unnest([time_bucket(INTERVAL 1 DAY, ts), time_bucket(INTERVAL 1 DAY, ts) - INTERVAL 1 DAY]) AS w FROM events) WHERE w + INTERVAL 2 DAY <= {_final} GROUP BY ALL""",
)
def _(spark, folder):
    return streamed(spark, folder, lambda s: stream.windowed_activity(s, "ts", "event_type", "value", "2 days", "1 day"))


@register(
    "stream_sessions",
    f"""WITH a AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER o < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts)),
    b AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS k FROM a)
    SELECT strftime(min(ts), '%Y-%m-%dT%H:%M:%SZ') AS start, strftime(max(ts) + INTERVAL 2 HOUR, '%Y-%m-%dT%H:%M:%SZ') AS "end", user_id, count(*) AS n FROM b GROUP BY user_id, k HAVING max(ts) + INTERVAL 2 HOUR <= {_final}""",
)
def _(spark, folder):
    return streamed(spark, folder, lambda s: stream.sessions(s, "ts", "user_id", "2 hours"))


@register("stream_first_delivery", "SELECT DISTINCT user_id, event_type FROM events WHERE ts IS NOT NULL")
def _(spark, folder):
    """One row per user and kind of event; in one delivery all repeats lie within the watermark."""
    return streamed(spark, folder, lambda s: stream.first_delivery(s.where("ts is not null").select("ts", "user_id", "event_type"), "ts", ["user_id", "event_type"]).select("user_id", "event_type"))


@register(
    "stream_state",
    f"""SELECT event_type, count(*) OVER w AS n, round(value, {DIGITS}) AS value, round(avg(value) OVER w, {DIGITS}) AS mean, round(CASE WHEN count(*) OVER w > 1 THEN stddev_samp(value) OVER w END, {DIGITS}) AS deviation
    FROM events WHERE value IS NOT NULL AND NOT isnan(value) WINDOW w AS (PARTITION BY event_type ORDER BY ts NULLS LAST, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
)
def _(spark, folder):
    return streamed(spark, folder, lambda s: stream.running_surprise(s, "event_type", "value", ["ts", "event_id"]))
