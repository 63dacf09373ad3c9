"""Exchange calendar operators: sessions from rules, day lookups, shifts by sessions.

The calendar is a dimension of about 252 sessions a year, whatever the size of the data,
so its sessions are read once, its day tables are made on the driver as literal relations
and broadcast; every lookup is an equi-join on the day.

Defined cases: a null day gives null lookups; days outside the calendar have no previous
or next session on that side; shifts stop at the calendar's ends.
"""

from __future__ import annotations

from datetime import date, timedelta

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

EPOCH = date(1970, 1, 1).toordinal()

#: One-off closures of the New York exchange (fixed values).
CLOSURES = [
    "2001-09-11", "2001-09-12", "2001-09-13", "2001-09-14", "2004-06-11", "2007-01-02", "2012-10-29", "2012-10-30", "2018-12-05", "2025-01-09",
]


def easter(year: int) -> date:
    """Gregorian Easter Sunday (the anonymous computus)."""
    a, b, c = year % 19, year // 100, year % 100
    h = (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30
    k = (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7
    n = h + k - 7 * ((a + 11 * h + 22 * k) // 451) + 114
    return date(year, n // 31, n % 31 + 1)


def nth_weekday(year: int, month: int, weekday: int, n: int) -> date:
    """The n-th (last for -1) given weekday of a month; Monday is 0."""
    if n > 0:
        first = date(year, month, 1)
        return first + timedelta(days=(weekday - first.weekday()) % 7 + 7 * (n - 1))
    last = date(year + month // 12, month % 12 + 1, 1) - timedelta(days=1)
    return last - timedelta(days=(last.weekday() - weekday) % 7)


def observed(day: date, saturday: bool = True) -> date:
    """A fixed holiday's observance: Sunday moves to Monday, Saturday to Friday unless told otherwise."""
    if day.weekday() == 6:
        return day + timedelta(days=1)
    return day - timedelta(days=1) if day.weekday() == 5 and saturday else day


def exchange_holidays(year: int) -> list[date]:
    """Weekday holidays of the New York exchange in a year."""
    days = [observed(date(year, 1, 1), saturday=False), nth_weekday(year, 2, 0, 3), easter(year) - timedelta(days=2), nth_weekday(year, 5, 0, -1)]
    days += [observed(date(year, 7, 4)), nth_weekday(year, 9, 0, 1), nth_weekday(year, 11, 3, 4), observed(date(year, 12, 25))]
    if year >= 1998:
        days.append(nth_weekday(year, 1, 0, 3))
    if year >= 2022:
        days.append(observed(date(year, 6, 19)))
    return sorted(d for d in [*days, *(date.fromisoformat(c) for c in CLOSURES if c.startswith(str(year)))] if d.weekday() < 5)


def exchange_sessions(spark: SparkSession, start: str, end: str) -> DataFrame:
    """session_date, ord: the exchange's sessions in [start, end], numbered from 0."""
    first, last = date.fromisoformat(start), date.fromisoformat(end)
    closed = [h.isoformat() for y in range(first.year, last.year + 1) for h in exchange_holidays(y)]
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first), F.lit(last))).alias("session_date"))
    kept = days.where(F.dayofweek("session_date").between(2, 6) & ~F.date_format("session_date", "yyyy-MM-dd").isin(closed))
    return kept.withColumn("ord", F.row_number().over(Window.orderBy("session_date")) - 1)


def literal(spark: SparkSession, columns: dict[str, pa.Array]) -> DataFrame:
    """A small table as a literal relation of the plan."""
    return spark.createDataFrame(pa.table(columns))


def picked(values: np.ndarray, at: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Values at positions, null where a position is out of range."""
    inside = (at >= 0) & (at < len(values))
    chosen = values[np.clip(at, 0, max(0, len(values) - 1))] if len(values) else np.zeros(len(at), dtype="int32")
    return pa.array(chosen.astype("int32"), mask=~inside).cast(kind)


def session_arrays(sessions: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Day numbers and ordinals of the sessions, in order: about 252 a year."""
    rows = sorted((r["session_date"].toordinal() - EPOCH, r["ord"]) for r in sessions.select("session_date", "ord").where("session_date is not null").collect())
    return np.array([d for d, _ in rows], dtype="int64"), np.array([o for _, o in rows], dtype="int64")


def day_table(sessions: DataFrame, margin: int = 400) -> DataFrame:
    """One row per calendar day: day, is_session, ord, previous and next session (strictly before and after), nearest ordinal.

    The nearest session of a closed day is the later one when both are equally far.
    ``margin``: calendar days covered beyond the first and last session.
    """
    at, number = session_arrays(sessions)
    days = np.arange(at[0] - margin, at[-1] + margin + 1) if len(at) else np.array([], dtype="int64")
    first, after = np.searchsorted(at, days, "left"), np.searchsorted(at, days, "right")
    before, open_ = first - 1, after > first
    far = lambda i: np.where((i >= 0) & (i < len(at)), np.abs(at[np.clip(i, 0, len(at) - 1)] - days), np.iinfo("int64").max) if len(at) else days
    near = np.where(open_, first, np.where(far(before) < far(after), before, after))
    date_, int_ = pa.date32(), pa.int32()
    return literal(
        sessions.sparkSession,
        {
            "day": pa.array(days.astype("int32")).cast(date_), "is_session": pa.array(open_), "ord": picked(number, np.where(open_, first, -1), int_), "prev_session": picked(at, before, date_), "prev_ord": picked(number, before, int_),
            "next_session": picked(at, after, date_), "next_ord": picked(number, after, int_), "near_ord": picked(number, near, int_),
        },
    )


def with_day(df: DataFrame, day: str, days: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Adds columns of the day table, looked up by ``day``; ``columns`` maps day-table names to new names."""
    side = days.select(F.col("day").alias("__day"), *[F.col(k).alias(v) for k, v in columns.items()])
    return df.join(F.broadcast(side), F.col(day) == F.col("__day"), "left").drop("__day")


def shift_table(days: DataFrame, sessions: DataFrame, shifts: dict[str, int]) -> DataFrame:
    """Per day its nearest ordinal and the session (and ``<name>_ord``) each shift leads to from the nearest session, within the calendar. As small as the calendar."""
    at, number = session_arrays(sessions)
    rows = days.select("day", "near_ord").collect()
    near = np.array([-1 if r["near_ord"] is None else r["near_ord"] for r in rows], dtype="int64")
    known = np.array([r["near_ord"] is not None for r in rows], dtype=bool)
    place = {o: i for i, o in enumerate(number.tolist())}
    table = {"day": pa.array([r["day"] for r in rows], pa.date32()), "near_ord": pa.array(near.astype("int32"), mask=~known)}
    for name, n in shifts.items():
        wanted = np.clip(near + n, 0, number.max(initial=0))
        found = np.array([place.get(o, -1) if k else -1 for o, k in zip(wanted.tolist(), known)], dtype="int64")
        table |= {name: picked(at, found, pa.date32()), f"{name}_ord": picked(number, found, pa.int32())}
    return literal(days.sparkSession, table)


def shift_sessions(df: DataFrame, day: str, n: int, days: DataFrame, sessions: DataFrame, out: str) -> DataFrame:
    """Adds the session ``n`` sessions after (before, if negative) the one nearest to ``day``, within the calendar."""
    return with_day(df, day, shift_table(days, sessions, {"__target": n}), {"__target": out})


def only_sessions(df: DataFrame, day: str, sessions: DataFrame) -> DataFrame:
    """Rows whose day is a session."""
    return df.join(F.broadcast(sessions.select(F.col("session_date").alias(day))), day, "left_semi")


def market_date(stamp: Column | str, zone: str = "America/New_York") -> Column:
    """The wall date of an instant in a zone."""
    return F.to_date(F.from_utc_timestamp(stamp, zone))


def at_clock(day: Column | str, hours: int, minutes: int, zone: str = "America/New_York") -> Column:
    """The instant of a wall clock time on a day in a zone."""
    c = F.col(day) if isinstance(day, str) else day
    return F.to_utc_timestamp(c.cast("timestamp") + F.expr(f"INTERVAL {hours} HOURS {minutes} MINUTES"), zone)
