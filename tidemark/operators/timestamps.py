"""Mixed timestamp notations and zones, normalised to one form.

Texts are read into instants, wall times or bare days. A wall time takes the zone the text
names, else the row's zone column, else the zone of its source's offset history. That
history is the cheapest path through the source's batches: each candidate zone costs the
order violations it causes against known instants (ingestion, or the record's other stamp),
and a change of zone costs ``change``. A source with a declared home zone has that one
candidate, so its history needs no costs and its texts are read once; any other source is
estimated from all candidates. Then wall times are converted, and those their zone had
twice or never are dropped.

Defined cases: null, blank and unreadable texts, impossible dates and clock times, a bare
day where an instant is needed, an unknown zone name in a text, and a weekday that is
not the date's give no row; an unknown name in the zone column or as home zone counts as none; a wall
time of a source without any evidence takes the first candidate; repeated rows each give
their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.grouped import map_sorted_groups
from tidemark.functions.timetext import DAY, INSTANT, NONE, WALL, known_zone, read_time_text

READ = "row_id long, field_name string, wanted string, source string, batch int, form int, value long, zone string, home string, not_before long, not_after long"
DAY_US = 86_400_000_000
#: Zones tried for sources that declare none (parameter default).
CANDIDATES = ["UTC", "America/New_York", "America/Chicago", "Europe/London", "Europe/Berlin", "Asia/Kolkata", "Asia/Tokyo", "Australia/Sydney"]


def read_fields(fields: list[tuple[str, str]], ordered: bool):
    """Reads each text field of a batch; with ``ordered``, the fields of a row happened in the order given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = {n: batch.column(n).to_pylist() for n in batch.schema.names}
            zone = [known_zone(z) for z in columns["zone"]]
            read = {name: [read_time_text(t, o) for t, o in zip(columns[f"text_{i}"], columns["date_order"])] for i, (name, _) in enumerate(fields)}
            known = {name: [v if f == INSTANT else None for f, v, _ in read[name]] for name, _ in fields}
            for i, (name, wanted) in enumerate(fields):
                form, value, text_zone = zip(*read[name])
                before = [known[n] for n, _ in fields[:i]] if ordered else []
                after = [known[n] for n, _ in fields[i + 1 :]] if ordered else []
                bound = lambda sides, pick: [pick((v for v in vs if v is not None), default=None) for vs in zip(*sides)] if sides else [None] * len(form)
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(columns["row_id"], pa.int64()), pa.array([name] * n, pa.string()), pa.array([wanted] * n, pa.string()), pa.array(columns["source"], pa.string()), pa.array(columns["batch"], pa.int32()),
                        pa.array(form, pa.int32()), pa.array(value, pa.int64()), pa.array([t or z for t, z in zip(text_zone, zone)], pa.string()), pa.array(columns["home_zone"], pa.string()), pa.array(bound(before, max), pa.int64()), pa.array(bound(after, min), pa.int64()),
                    ],
                    names=["row_id", "field_name", "wanted", "source", "batch", "form", "value", "zone", "home", "not_before", "not_after"],
                )

    return run


def known_homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Feeds with their home zone, null where its name is no zone's."""
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([known_zone(z) for z in batch.column(1).to_pylist()], pa.string()), batch.column(2)], names=["_s", "home_zone", "date_order"])


def to_instant(wall: Column, zone: Column) -> Column:
    """Instant (microseconds) of a wall time in a zone; null if the zone had it twice or never."""
    local = lambda at: F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(at), zone))
    early, late = wall - DAY_US, wall + DAY_US
    first, second = wall - (local(early) - early), wall - (local(late) - late)
    both = F.when(local(first) == wall, first), F.when(local(second) == wall, second)
    return F.when(first == second, both[0]).when(both[0].isNull(), both[1]).when(both[1].isNull(), both[0])


def cheapest_history(change: float):
    """Per source, the zone of each batch on the path with the fewest violations and changes."""

    def run(chunk: pd.DataFrame) -> pd.DataFrame:
        out = []
        for source, rows in chunk.groupby("source", dropna=False, sort=False):
            table = rows.pivot_table(index="batch", columns="place", values="violations", aggfunc="sum").sort_index()
            cost, names = table.to_numpy(), rows.drop_duplicates("place").set_index("place")["candidate"]
            back = np.zeros(cost.shape, dtype=int)
            total = cost[0].copy()
            for i in range(1, len(cost)):
                best = int(total.argmin())
                stay = total <= total[best] + change
                back[i] = np.where(stay, np.arange(len(total)), best)
                total = np.where(stay, total, total[best] + change) + cost[i]
            at = int(total.argmin())
            path = [at]
            for i in range(len(cost) - 1, 0, -1):
                at = back[i][at]
                path.append(int(at))
            out.append(pd.DataFrame({"source": source, "batch": table.index, "candidate": [names[table.columns[p]] for p in reversed(path)]}))
        return pd.concat(out)

    return run


def normalize_times(
    rows: DataFrame, sources: DataFrame, row_id: str, source: str, fields: list[tuple[str, str]], zone: str | None = None, batch: str | None = None, ordered: bool = False,
    calendar_zone: str = "America/New_York", candidates: list[str] | None = None, change: float = 2.0, longest_hours: float = 720.0,
) -> DataFrame:
    """One row per readable text: row_id, field_name, normal_form.

    ``fields``: (column, 'instant' or 'date'). ``sources`` (source, home_zone, date_order): one
    row per feed; it is joined by shuffle unless Spark finds it small. ``zone``: the
    column that names a row's zone; ``batch``: the sequence in which a source delivered;
    ``longest_hours``: how far apart two stamps of a record may lie before that counts as a violation.
    """
    home = sources.select(F.col("source").cast("string").alias("_s"), F.col("home_zone").cast("string"), F.col("date_order").cast("string")).mapInArrow(known_homes, "_s string, home_zone string, date_order string")
    pick = rows.select(
        F.col(row_id).cast("long").alias("row_id"), F.col(source).alias("source"), (F.col(zone) if zone else F.lit(None).cast("string")).alias("zone"), (F.col(batch).cast("int") if batch else F.lit(0)).alias("batch"), *[F.col(n).alias(f"text_{i}") for i, (n, _) in enumerate(fields)]
    )
    joined = pick.join(home, F.col("source") == F.col("_s"), "left").drop("_s")
    reader = read_fields(fields, ordered)
    read = joined.mapInArrow(reader, READ).where(F.col("form") != NONE)
    # only texts of sources without a home zone are read for costs as well
    unknown = joined.where("home_zone is null").mapInArrow(reader, READ)
    tried = unknown.where((F.col("form") == WALL) & F.col("zone").isNull()).select("source", "batch", "value", "not_before", "not_after", F.posexplode(F.array(*map(F.lit, candidates or CANDIDATES))).alias("place", "candidate"))
    at = to_instant(F.col("value"), F.col("candidate"))
    slack = int(longest_hours * 3_600_000_000)
    broken = at.isNull() | (at < F.col("not_before")) | (at > F.col("not_after")) | (at > F.col("not_before") + slack) | (at < F.col("not_after") - slack)
    costs = tried.groupBy("source", "batch", "place", "candidate").agg(F.sum(F.coalesce(broken, F.lit(False)).cast("int")).cast("double").alias("violations"))
    history = map_sorted_groups(costs, ["source"], ["batch", "place"], cheapest_history(change), "source string, batch int, candidate string").alias("h")
    zoned = read.alias("r").join(history, F.col("r.source").eqNullSafe(F.col("h.source")) & (F.col("r.batch") == F.col("h.batch")) & (F.col("form") == WALL) & F.col("home").isNull(), "left")
    instant = F.when(F.col("form") == INSTANT, F.col("value")).when(F.col("form") == WALL, to_instant(F.col("value"), F.coalesce("zone", "home", "candidate")))
    stamp = F.timestamp_micros("instant")
    form = F.when(F.col("wanted") == "instant", F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).otherwise(
        F.date_format(F.when(F.col("form") == DAY, F.date_from_unix_date(F.col("value").cast("int"))).otherwise(F.to_date(F.from_utc_timestamp(stamp, calendar_zone))), "yyyy-MM-dd")
    )
    return zoned.withColumn("instant", instant).select("row_id", "field_name", form.alias("normal_form")).where("normal_form is not null")
