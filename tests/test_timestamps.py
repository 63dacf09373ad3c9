import os
from datetime import datetime, timezone

import pytest
from oracle import FOLDER

from tidemark.functions.timetext import DAY, INSTANT, NONE, WALL, read_time_text
from tidemark.operators.timestamps import normalize_times
from tidemark.plans import data_problems


def utc(*a):
    return int(datetime(*a, tzinfo=timezone.utc).timestamp() * 1e6)


@pytest.mark.parametrize(
    "text, order, want",
    [
        ("1720000000", None, (INSTANT, 1720000000000000, None)), ("1720000000123", None, (INSTANT, 1720000000123000, None)), ("1720000000123456", None, (INSTANT, 1720000000123456, None)), ("1720000000.25", None, (INSTANT, 1720000000250000, None)),
        ("2024-07-12T12:24:48.484594540+09:00[Asia/Tokyo]", None, (INSTANT, utc(2024, 7, 12, 3, 24, 48) + 484594, None)), ("Mon, 16 Dec 2024 16:32:19 -0500", None, (INSTANT, utc(2024, 12, 16, 21, 32, 19), None)),
        ("Tue, 16 Dec 2024 16:32:19 -0500", None, (NONE, 0, None)), ("20250207 22:27:00", None, (WALL, utc(2025, 2, 7, 22, 27), None)), ("20240216T221201", None, (WALL, utc(2024, 2, 16, 22, 12, 1), None)), ("20230330235400", None, (WALL, utc(2023, 3, 30, 23, 54), None)),
        ("27-AUG-25, 10:09 ET", None, (WALL, utc(2025, 8, 27, 10, 9), "America/New_York")), ("2024-05-06 09:12:27 PM EDT", None, (INSTANT, utc(2024, 5, 7, 1, 12, 27), None)), ("2024-01-26 12:05 a.m.", None, (WALL, utc(2024, 1, 26, 0, 5), None)),
        ("03/04/2024 08:00", "mdy", (WALL, utc(2024, 3, 4, 8), None)), ("03/04/2024 08:00", "dmy", (WALL, utc(2024, 4, 3, 8), None)), ("03/04/2024 08:00", "ymd", (NONE, 0, None)), ("31.11.2024 09:15", "dmy", (NONE, 0, None)),
        ("2024/7/9", None, (DAY, 19913, None)), ("May 9 2024", None, (DAY, 19852, None)), (" Feb 8, 2025  22:57 ", None, (WALL, utc(2025, 2, 8, 22, 57), None)), ("2024-02-30", None, (NONE, 0, None)), ("2024-05-14T25:10:00Z", None, (NONE, 0, None)),
        ("2025-01-15 13:00 pm", None, (NONE, 0, None)), ("2024-01-01 10:00 XYZ", None, (NONE, 0, None)), ("2024-01-01T10:00[Nowhere/Land]", None, (NONE, 0, None)), ("pending", None, (NONE, 0, None)), ("", None, (NONE, 0, None)), (None, None, (NONE, 0, None)), ("x" * 100_000, None, (NONE, 0, None)),
        ("2023-03-21T22:24:51z", None, (INSTANT, utc(2023, 3, 21, 22, 24, 51), None)), ("2024-11-08 08:07:23,216-0500", None, (INSTANT, utc(2024, 11, 8, 13, 7, 23) + 216000, None)),
    ],
)
def test_reading(text, order, want):
    assert read_time_text(text, order) == want


SOURCES = [("ny", "America/New_York", "mdy"), ("ldn", "Europe/London", "dmy"), ("lost", None, "ymd")]


def sources(spark):
    return spark.createDataFrame(SOURCES, "source string, home_zone string, date_order string")


def forms(df):
    return {(r.row_id, r.field_name): r.normal_form for r in df.collect()}


def test_zone_precedence_gaps_and_overlaps(spark):
    rows = [
        (1, "ny", None, "2024-07-01 10:00:00"), (2, "ny", "Asia/Tokyo", "2024-07-01 10:00:00"), (3, "ny", "Asia/Tokyo", "2024-07-01 10:00:00 EDT"), (4, "ny", None, "2024-03-10 02:30:00"), (5, "ny", None, "2024-11-03 01:30:00"),
        (6, "ny", "Not/AZone", "2024-11-03 03:30:00"), (7, "ny", None, "2024-07-01"), (8, "ldn", None, "31/03/2024 02:30"), (9, "ldn", None, "31/03/2024 01:30"), (10, None, None, "2024-07-01T00:00:00Z"), (10, None, None, "2024-07-01T00:00:00Z"),
    ]
    df = spark.createDataFrame(rows, "raw_id long, source string, zone string, t string")
    got = normalize_times(df, sources(spark), "raw_id", "source", [("t", "instant")], zone="zone")
    assert got.count() == 7
    assert forms(got) == {
        (1, "t"): "2024-07-01T14:00:00.000000Z", (2, "t"): "2024-07-01T01:00:00.000000Z", (3, "t"): "2024-07-01T14:00:00.000000Z", (6, "t"): "2024-11-03T08:30:00.000000Z", (8, "t"): "2024-03-31T01:30:00.000000Z", (10, "t"): "2024-07-01T00:00:00.000000Z",
    } | {(10, "t"): "2024-07-01T00:00:00.000000Z"}


def test_dates_are_new_york_dates(spark):
    rows = [(1, "ldn", "02/03/2024"), (2, "ldn", "02/03/2024 03:00"), (3, "ny", "2024-03-02T02:00:00Z"), (4, "ny", "n/a"), (5, "ny", None)]
    df = spark.createDataFrame(rows, "raw_id long, source string, date string")
    got = normalize_times(df, sources(spark), "raw_id", "source", [("date", "date")])
    assert forms(got) == {(1, "date"): "2024-03-02", (2, "date"): "2024-03-01", (3, "date"): "2024-03-01"}


def test_missing_zone_is_estimated_from_order(spark):
    # the undeclared source writes Tokyo walls at first and Berlin walls later; each record's second stamp is a known instant shortly after
    rows = []
    for i in range(40):
        known = datetime(2024, 1, 5, tzinfo=timezone.utc).timestamp() + 86400 * i
        local = datetime.fromtimestamp(known - 600 + (9 if i < 20 else 1) * 3600, timezone.utc)
        rows.append((i, "lost", i // 4, local.strftime("%Y-%m-%d %H:%M:%S"), datetime.fromtimestamp(known, timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")))
    df = spark.createDataFrame(rows, "raw_id long, source string, batch int, told string, filed string")
    # within two hours only the right zone keeps the order
    got = forms(normalize_times(df, sources(spark), "raw_id", "source", [("told", "instant"), ("filed", "instant")], batch="batch", ordered=True, candidates=["Asia/Tokyo", "Europe/Berlin"], longest_hours=2))
    for i in range(40):
        want = datetime(2024, 1, 5, tzinfo=timezone.utc).timestamp() + 86400 * i - 600
        assert got[(i, "told")] == datetime.fromtimestamp(want, timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.%fZ")


def test_unknown_home_zone_counts_as_none(spark):
    feeds = spark.createDataFrame([("x", "No/Where", "ymd")], "source string, home_zone string, date_order string")
    df = spark.createDataFrame([(1, "x", "2024-07-01 10:00")], "raw_id long, source string, zone string")
    assert forms(normalize_times(df, feeds, "raw_id", "source", [("zone", "instant")], candidates=["Asia/Tokyo"])) == {(1, "zone"): "2024-07-01T01:00:00.000000Z"}


def test_empty(spark):
    df = spark.createDataFrame([], "raw_id long, source string, date string")
    assert normalize_times(df, sources(spark), "raw_id", "source", [("date", "date")]).collect() == []


def test_histories_of_hidden_zones_are_found(spark):
    """Announcements written as wall times in zones that change: nearly all get their instant back."""
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables")
    rows = data_problems.p3_history(spark, "/root/testdata/sf0.01").collect()
    assert sum(r.recovered for r in rows) >= 0.9 * sum(r.texts for r in rows)


def test_texts_of_sources_with_a_home_zone_and_without(spark):
    feeds = spark.createDataFrame([("home", "America/New_York", "mdy"), ("bad", "Nowhere/None", "mdy"), ("none", None, "mdy")], "source string, home_zone string, date_order string")
    rows = spark.createDataFrame([(1, "home", "2024-01-05 10:00:00"), (2, "bad", "2024-01-05 10:00:00"), (3, "none", "2024-01-05 10:00:00"), (4, "new", "2024-01-05 10:00:00"), (5, None, "2024-01-05T10:00Z")], "id long, source string, t string")
    got = {r.row_id: r.normal_form for r in normalize_times(rows, feeds, "id", "source", [("t", "instant")], candidates=["Asia/Tokyo"]).collect()}
    assert got == {1: "2024-01-05T15:00:00.000000Z", **dict.fromkeys((2, 3, 4), "2024-01-05T01:00:00.000000Z"), 5: "2024-01-05T10:00:00.000000Z"}
