import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators.spikes import Field, find_spikes

FIELDS = [Field("p", fence=8.0), Field("v", fence=5.0, factor=12.0, level=5, zero_ok=True)]
SCHEMA = "id long, s string, d date, t long, p double, v double"


def series(n=160, seed=6, name="a", start=0):
    rng = np.random.default_rng(seed)
    p = 50 * np.exp(np.cumsum(rng.normal(0, 0.01, n)))
    v = 1e5 * np.exp(rng.normal(0, 0.3, n))
    day = datetime.date(2024, 1, 1)
    return [[start + i, name, day + datetime.timedelta(days=i), i, round(float(p[i]), 4), round(float(v[i]))] for i in range(n)]


def flags(spark, rows, **options):
    df = spark.createDataFrame([(a, b, c, d, None if e is None else float(e), None if f is None else float(f)) for a, b, c, d, e, f in rows], SCHEMA).withColumn("block", F.lit("clash")).withColumn("kind", F.lit(1))
    return {(r.id, r.field_name) for r in find_spikes(df.select("id", "s", "d", "t", "p", "v", "kind"), ["s"], "id", "d", "t", "v", FIELDS, **options).collect()}


def test_clean_series_is_quiet(spark):
    assert flags(spark, series()) == set()


@pytest.mark.parametrize("block", [20, 64, 768])
def test_planted_faults_are_found_and_lasting_moves_are_not(spark, block):
    rows = series()
    want = set()
    for i in (30,):
        rows[i][4] *= 1.4
        want.add((i, "p"))
    for i in (60, 61, 62):
        rows[i][4] *= 0.7
        want.add((i, "p"))
    for r in rows[80:]:
        r[4] *= 0.5  # a split: lasts
    for i in (100, 101, 102, 103):
        rows[i][4] *= 1.3  # four bars: no spike
    for i in range(121, 130):
        rows[i][4] = rows[120][4]
        want.add((i, "p"))
    rows[140][4], rows[141][5], rows[142][4] = -1.0, -5.0, 0.0
    want |= {(140, "p"), (141, "v"), (142, "p")}
    rows[20][5] *= 300
    want.add((20, "v"))
    assert flags(spark, rows, block_days=block, edge_days=20) == want


def test_copies_and_restated_bars(spark):
    rows = series()
    bad = rows[50][4] * 3
    rows.append([900, "a", rows[50][2], 990, bad, rows[50][5]])  # restated wrongly, then put right
    rows.append([901, "a", rows[50][2], 991, bad, rows[50][5]])
    rows.append([902, "a", rows[50][2], 995, rows[50][4], rows[50][5]])
    assert flags(spark, rows) == {(900, "p"), (901, "p")}


def test_put_right_in_the_middle_of_an_excursion(spark):
    rows = series()
    right = rows[51][4]
    for i in (50, 51, 52):
        rows[i][4] *= 0.1
    rows.append([900, "a", rows[51][2], 995, right, rows[51][5]])
    for i in (80, 82):
        rows[i][4] *= 1.5  # two excursions with a normal bar between
    assert flags(spark, rows) == {(i, "p") for i in (50, 51, 52, 80, 82)}


def test_nulls_untraded_and_thin_sources(spark):
    rows = series()
    for i in range(40, 50):
        rows[i][4], rows[i][5] = rows[40][4], 0  # untraded: repeats are no fault
    rows[70][4] = rows[71][5] = None
    rows += [[500, None, rows[0][2], 0, -2.0, 1.0], [501, "thin", rows[0][2], 0, 5.0, 1.0], [502, "thin", None, 0, 0.0, None], [503, "thin", rows[1][2], 0, 900.0, 1.0]]
    assert flags(spark, rows) == {(500, "p"), (502, "p")}


def test_empty(spark):
    assert flags(spark, []) == set()
