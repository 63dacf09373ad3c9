"""Forward returns of events over exchange sessions.

Defined cases: an event lacking its entry, reaction or drift bar has null returns; a
missing benchmark or sector bar adjusts by 0; volatility needs five bars after entry.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def average_bars(bars: DataFrame, by: list[str]) -> DataFrame:
    """Equal-weight open and close per ``by`` and session: a benchmark or sector path."""
    return bars.groupBy(*by, "ord").agg(F.avg("open").alias("open"), F.avg("close").alias("close"))


def points(events: DataFrame, bars: DataFrame, names: dict[str, str]) -> DataFrame:
    """Per event and session it asks for, that session's bar: event_id, sector, tag, ord, open, close.

    ``names`` maps a tag to the column of its ordinal. The sessions are laid under each other, so the bars are met in one join.
    """
    asked = F.explode(F.array(*[F.struct(F.lit(tag).alias("tag"), F.col(column).cast("int").alias("ord")) for tag, column in names.items()]))
    sector = F.col("sector") if "sector" in events.columns else F.lit(None).cast("string").alias("sector")
    wanted = events.select("event_id", "security_id", sector, asked.alias("p")).select("event_id", "security_id", "sector", "p.*")
    return wanted.join(bars.select("security_id", "ord", "open", "close"), ["security_id", "ord"], "left")


def return_labels(events: DataFrame, bars: DataFrame, market: DataFrame, sector: DataFrame) -> DataFrame:
    """event_id, reaction and drift returns, each raw, less the market's and less the sector's.

    The reaction is entry open to entry close; the drift runs from the reaction exit's close to the drift exit's.
    ``market`` (ord, open, close) and ``sector`` (sector, ord, open, close) have a row per session (and sector).
    """
    side = lambda df, p: df.withColumnsRenamed({"open": f"{p}open", "close": f"{p}close"})
    met = points(events, bars, {"entry": "entry_ord", "rx": "rx_ord", "dx": "dx_ord"}).join(side(market, "m_"), "ord", "left").join(side(sector, "s_"), ["sector", "ord"], "left")
    value = lambda p, tag, c: F.max(F.when(F.col("tag") == tag, F.col(f"{p}{c}"))).alias(f"{p}{tag}_{c}")
    got = met.groupBy("event_id").agg(*[value(p, tag, c) for p in ("", "m_", "s_") for tag, c in (("entry", "open"), ("entry", "close"), ("rx", "close"), ("dx", "close"))])
    whole = F.col("entry_close").isNotNull() & F.col("rx_close").isNotNull() & F.col("dx_close").isNotNull()
    move = lambda p, a, b: F.try_divide(F.col(f"{p}{b}"), F.col(f"{p}{a}")) - 1
    columns = {}
    for name, a, b in (("reaction_car", "entry_open", "entry_close"), ("drift_car_20", "rx_close", "dx_close")):
        raw = move("", a, b)
        columns[name] = F.when(whole, raw)
        columns[f"{name}_market_adj"] = F.when(whole, raw - F.coalesce(move("m_", a, b), F.lit(0.0)))
        columns[f"{name}_sector_adj"] = F.when(whole, raw - F.coalesce(move("s_", a, b), F.lit(0.0)))
    return got.select("event_id", *[c.alias(n) for n, c in columns.items()])


def tradable_returns(events: DataFrame, bars: DataFrame) -> DataFrame:
    """event_id and the gross return from entry open to the exit's close, for the reaction and the drift exit; null where a bar is missing."""
    met = points(events, bars, {"entry": "entry_ord", "rx": "rx_ord", "dx": "dx_ord"})
    value = lambda tag, c: F.max(F.when(F.col("tag") == tag, F.col(c)))
    got = met.groupBy("event_id").agg(value("entry", "open").alias("_in"), value("rx", "close").alias("_rx"), value("dx", "close").alias("_dx"))
    return got.select("event_id", (F.try_divide("_rx", "_in") - 1).alias("gross_reaction"), (F.try_divide("_dx", "_in") - 1).alias("gross_drift"))


def realized_volatility(events: DataFrame, bars: DataFrame, least: int = 5, year: float = 252.0) -> DataFrame:
    """event_id, realized_vol_20, realized_vol_20_annualized over the bars in (entry, drift exit].

    An event reaches at most its holding period, so the range join is on (security, session):
    sessions are exploded per event (20 each) and met by equality. The first return lies inside the period.
    """
    held = events.where("entry_ord < dx_ord").select("event_id", "security_id", F.explode(F.sequence(F.col("entry_ord") + 1, F.col("dx_ord"))).alias("ord"))
    met = held.join(bars.select("security_id", "ord", "close"), ["security_id", "ord"])
    order = Window.partitionBy("event_id").orderBy("ord")
    moves = met.withColumn("move", F.ln("close") - F.ln(F.lag("close").over(order)))
    vol = moves.groupBy("event_id").agg(F.when(F.count(F.lit(1)) >= least, F.stddev_samp("move")).alias("realized_vol_20"))
    return events.select("event_id").join(vol, "event_id", "left").withColumn("realized_vol_20_annualized", F.col("realized_vol_20") * (year**0.5))


def override(labels: DataFrame, other: DataFrame, key: str, columns: dict[str, str]) -> DataFrame:
    """Replaces label columns by those of another table (null where it has no row); ``columns`` maps label to other name."""
    side = other.select(key, *[F.col(o).alias(f"_{c}") for c, o in columns.items()])
    return labels.join(side, key, "left").select(*[F.col(f"_{c}").alias(c) if c in columns else F.col(c) for c in labels.columns])


#: Which planted column stands for which labels, and by what factor.
PLANTED = {
    "planted_reaction": ["reaction_car", "reaction_car_market_adj", "reaction_car_sector_adj"], "planted_drift": ["drift_car_20", "drift_car_20_market_adj", "drift_car_20_sector_adj"],
    "planted_volatility": ["realized_vol_20"],
}


def override_planted(labels: DataFrame, events: DataFrame, year: float = 252.0) -> DataFrame:
    """All eight label columns from the events' planted reaction, drift and volatility (null where the event has none)."""
    planted = events.select("event_id", *PLANTED, (F.col("planted_volatility") * year**0.5).alias("_annual"))
    columns = {label: source for source, held in PLANTED.items() for label in held} | {"realized_vol_20_annualized": "_annual"}
    return override(labels, planted, "event_id", columns)
