"""Hand-computed facts for the event-study operators."""

from datetime import date, datetime

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import alignment, evaluation, features, integrity, labels, ranks, securities, tone
from tidemark.operators import calendar as cal


@pytest.fixture(scope="module")
def sessions(spark):
    return cal.exchange_sessions(spark, "2019-12-02", "2020-12-31").cache()


@pytest.fixture(scope="module")
def days(sessions):
    return cal.day_table(sessions).cache()


def look(spark, days, day):
    return cal.with_day(spark.createDataFrame([(date.fromisoformat(day),)], "d date"), "d", days, {"prev_session": "p", "next_session": "n", "is_session": "s"}).first()


def test_session_count_and_known_holidays(spark):
    got = cal.exchange_sessions(spark, "2010-01-01", "2026-07-29")
    assert got.count() == 4167
    assert cal.easter(2024) == date(2024, 3, 31) and cal.nth_weekday(2020, 9, 0, 1) == date(2020, 9, 7)
    assert date(2021, 12, 24) in cal.exchange_holidays(2021) and date(2022, 1, 1) not in cal.exchange_holidays(2022) and date(2021, 6, 18) not in cal.exchange_holidays(2021)


@pytest.mark.parametrize("day, p, n", [("2020-02-01", "2020-01-31", "2020-02-03"), ("2020-09-07", "2020-09-04", "2020-09-08"), ("2020-01-29", "2020-01-28", "2020-01-30"), ("2020-02-02", "2020-01-31", "2020-02-03")])
def test_neighbouring_sessions(spark, days, day, p, n):
    got = look(spark, days, day)
    assert (str(got.p), str(got.n)) == (p, n)


def test_shifts_snap_clamp_and_come_back(spark, days, sessions):
    df = spark.createDataFrame([(date(2020, 2, 1),), (date(2020, 2, 2),), (date(2020, 1, 29),), (None,)], "d date")
    got = {r.d: r for r in cal.shift_sessions(cal.shift_sessions(cal.shift_sessions(df, "d", 0, days, sessions, "z"), "d", 20, days, sessions, "a"), "a", -20, days, sessions, "b").collect()}
    assert got[date(2020, 2, 1)].z == date(2020, 1, 31) and got[date(2020, 2, 2)].z == date(2020, 2, 3)  # nearest, a tie would go to the later one
    assert got[date(2020, 1, 29)].b == date(2020, 1, 29) and got[None].a is None
    far = cal.shift_sessions(df, "d", 10_000, days, sessions, "x").where("d is not null").select("x").distinct().collect()
    assert [r.x for r in far] == [date(2020, 12, 31)]


def ev(spark, *rows):
    return spark.createDataFrame([(i, "S1", date(2019, 12, 31), c, datetime.fromisoformat(t) if t else None) for i, c, t in rows], "event_id string, security_id string, fiscal_period_end date, timing_class string, announcement_timestamp timestamp")


def test_effective_dates(spark, days):
    rows = ev(spark, ("a", "after_market_close", "2020-01-28T21:30:00"), ("b", "after_market_close", "2020-10-30T20:00:00"), ("c", "before_market_open", "2020-01-14T11:45:00"), ("d", "before_market_open", "2020-02-01T13:00:00"), ("e", "intraday", "2020-01-29T17:00:00"), ("f", "before_market_open", "2020-01-29T04:30:00"), ("g", "unknown", None))
    got = {r.event_id: str(r.effective_date) for r in alignment.effective_dates(rows, days).collect()}
    # f: 4:30 UTC is still the evening before in New York
    assert got == {"a": "2020-01-29", "b": "2020-11-02", "c": "2020-01-14", "d": "2020-02-03", "e": "2020-01-30", "f": "2020-01-28", "g": "None"}
    with pytest.raises(PySparkException):
        alignment.effective_dates(ev(spark, ("a", "totally_made_up", "2020-01-28T21:30:00")), days).collect()


def test_master_keeps_the_first_and_stamps_it(spark, days, sessions):
    rows = ev(spark, ("z", "intraday", "2020-01-28T15:00:00"), ("a", "after_market_close", "2020-01-28T21:30:00"), ("n", "before_market_open", None))
    (row,) = alignment.event_master(rows, days, sessions).collect()
    assert (row.event_id, row.exclusion_reason, row.data_quality_status) == ("z", "timing_intraday", "excluded")
    clock = alignment.event_master(rows, days, sessions).select(F.date_format("prediction_timestamp", "HH:mm").alias("p"), F.date_format("order_submission_cutoff", "HH:mm").alias("c")).first()
    assert (clock.p, clock.c) == ("14:35", "14:25")
    assert str(row.reaction_exit) == "2020-01-30" and str(row.drift_exit) == "2020-02-27"
    assert alignment.primary(alignment.event_master(rows, days, sessions)).count() == 0


def bars(spark, closes, opens=None, first=0):
    return spark.createDataFrame([("S1", first + i, float(opens[i] if opens else c), float(c), 100.0) for i, c in enumerate(closes)], "security_id string, ord int, open double, close double, volume double")


def test_returns(spark):
    e = spark.createDataFrame([("e", "S1", "T", 0, 1, 3), ("gap", "S1", None, 0, 1, 9)], "event_id string, security_id string, sector string, entry_ord int, rx_ord int, dx_ord int")
    b = bars(spark, [101, 101, 102, 103], [100, 101, 102, 103])
    none = b.limit(0).groupBy("ord").agg(F.avg("open").alias("open"), F.avg("close").alias("close"))
    got = {r.event_id: r for r in labels.return_labels(e, b, none, none.withColumn("sector", F.lit("T"))).collect()}
    assert got["e"].reaction_car == pytest.approx(0.01) == got["e"].reaction_car_market_adj and got["e"].drift_car_20 == pytest.approx(103 / 101 - 1)
    assert got["gap"].reaction_car is None
    same = labels.average_bars(b, [])
    full = labels.return_labels(e, b, same, same.withColumn("sector", F.lit("T"))).where("event_id = 'e'").first()
    assert full.reaction_car_market_adj == pytest.approx(0) == full.drift_car_20_sector_adj


def test_realized_volatility_leaves_the_entry_return_out(spark):
    import numpy as np

    closes = [50, 100, 101, 103, 99, 104, 120]
    e = spark.createDataFrame([("e", "S1", 0, 5), ("short", "S1", 2, 5)], "event_id string, security_id string, entry_ord int, dx_ord int")
    got = {r.event_id: r for r in labels.realized_volatility(e, bars(spark, closes)).collect()}
    want = np.std(np.diff(np.log(closes[1:6])), ddof=1)
    assert got["e"].realized_vol_20 == pytest.approx(want) and got["e"].realized_vol_20_annualized == pytest.approx(want * 252**0.5)
    assert got["short"].realized_vol_20 is None


def test_surprises(spark):
    rows = [("S1", i, a, e) for i, (a, e) in enumerate([(1.1, 1.0), (1.2, 1.0), (0.9, 1.0), (1.3, 1.0), (None, 1.0), (1.2, 0.0), (1.5, 1.0)])]
    df = spark.createDataFrame([(f"e{i}", s, date(2020, 1, 1 + i), a, e, None, None) for s, i, a, e in rows], "event_id string, security_id string, effective_date date, actual_eps double, estimated_eps double, actual_revenue double, estimated_revenue double")
    got = features.surprises(df).orderBy("event_id").collect()
    assert [r.beat_streak for r in got] == [1, 2, 0, 1, 0, 1, 2]
    assert [r.beat for r in got] == [1, 1, 0, 1, 0, 1, 1]
    assert got[0].surprise_std_hist is None and got[1].surprise_std_hist is None and got[2].surprise_std_hist == pytest.approx(0.0707106, abs=1e-6)
    assert got[4].eps_surprise_pct is None and got[5].eps_surprise_pct is None and got[5].sue is None
    assert got[3].prev_surprise_pct == pytest.approx(-0.1)


def test_market_context_sees_only_bars_before_entry(spark):
    closes = [100 + (i * 7) % 11 for i in range(60)]
    e = spark.createDataFrame([("e", "S1", 40), ("early", "S1", 3), ("after", "S1", 99), ("other", "S9", 40)], "event_id string, security_id string, entry_ord int")
    windows = dict(least=20, short=3, mid=5, long=10, volatility=8, volume=8)
    full = {r.event_id: r for r in features.market_context(e, bars(spark, closes), **windows).collect()}
    cut = {r.event_id: r for r in features.market_context(e, bars(spark, closes[:40]), **windows).collect()}
    assert full["e"] == cut["e"] and full["e"].mom_1m == pytest.approx(closes[39] / closes[36] - 1)
    assert full["e"].dist_high == pytest.approx(closes[39] / max(closes[30:40]) - 1)
    assert full["early"].mom_1m is None and full["other"].mom_1m is None and full["after"].mom_1m == pytest.approx(closes[59] / closes[56] - 1)
    import numpy as np

    moves = np.diff(closes[:40]) / np.array(closes[:39])
    assert full["e"].downside_vol_3m == pytest.approx(np.std(moves[moves < 0][-8:], ddof=1)) and full["e"].rv_3m == pytest.approx(np.std(moves[-8:], ddof=1))


@pytest.mark.parametrize("n, rows", [(5, 2), (5, 7), (5, 11), (5, 100), (3, 4), (3, 10), (3, 77)])
def test_quantile_buckets_follow_the_linear_quantiles_of_ranks(spark, n, rows):
    import numpy as np

    df = ranks.bucketed(spark.range(rows), [], "id", "id", n)
    place = np.arange(1, rows + 1)
    cuts = np.quantile(place, np.arange(1, n) / n)
    on_cut = np.isclose(place[:, None], cuts[None, :])
    want = 1 + ((place[:, None] > cuts[None, :]) & ~on_cut).sum(axis=1) + (on_cut.any(axis=1) if n == 3 else 0)
    assert [r.bucket for r in df.orderBy("id").collect()] == want.tolist()


def test_single_row_has_no_bucket(spark):
    assert ranks.bucketed(spark.range(1), [], "id", "id", 5).first().bucket is None
    assert ranks.bucketed(spark.range(0), [], "id", "id", 5).collect() == []


def test_folds(spark):
    folds = evaluation.make_folds(spark, "2015-01-01", "2018-12-31", "2019-01-01", "2019-12-31", "2020-01-01", "2025-12-31").orderBy("fold").collect()
    assert [f.fold for f in folds] == [f"test_{y}" for y in range(2020, 2026)] and all(f.train_end < f.test_start for f in folds)
    rows = spark.createDataFrame([(date(2019, 6, 1),), (date(2020, 6, 1),)], "d date")
    got = sorted((str(r.d), r.fold, r.role) for r in evaluation.fold_members(rows, "d", spark.createDataFrame(folds[:2])).collect())
    assert got == [("2019-06-01", "test_2020", "val"), ("2019-06-01", "test_2021", "train"), ("2020-06-01", "test_2020", "test"), ("2020-06-01", "test_2021", "val")]


def predictions(spark, rows):
    return spark.createDataFrame(rows, "model string, fold string, event_id string, prediction double, actual double")


def test_scenario_sweep_pays_on_both_sides(spark):
    rows = predictions(spark, [("m", "f", f"{i:02}", float(i), i / 100) for i in range(10)])
    got = {r.level: r for r in evaluation.scenario_sweep(evaluation.fold_buckets(rows), "actual", "bucket", 5, [0.0, 0.002]).collect()}
    for c in (0.0, 0.002):
        assert got[c].top_net == pytest.approx(0.085 - c) and got[c].bottom_net == pytest.approx(-0.005 - c) and got[c].spread_net == pytest.approx(0.08 - 2 * c)


def test_buckets_are_formed_within_folds(spark):
    rows = predictions(spark, [("m", f, f"{f}{i}", float(base + i), 0.0) for f, base in (("a", 1), ("b", 101)) for i in range(5)])
    top = {r.event_id for r in evaluation.fold_buckets(rows).where("bucket = 5").collect()}
    assert top == {"a4", "b4"}


def test_metrics_against_plain_definitions(spark):
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(1)
    p = np.round(rng.normal(size=60), 1)
    a = p * 0.5 + rng.normal(size=60)
    rows = [("m", "f", str(i), float(x), float(y)) for i, (x, y) in enumerate(zip(p, a))] + [("m", "f", "n", None, 1.0), ("m", "f", "x", float("nan"), 1.0), ("flat", "f", "1", 0.1, 1.0)] + [("flat", "f", str(i), 0.1, float(i)) for i in range(9)]
    got = {r.model: r for r in evaluation.group_metrics(predictions(spark, rows), ["model"]).collect()}
    m = got["m"]
    assert m.n == 60 and m.pearson == pytest.approx(np.corrcoef(p, a)[0, 1]) and m.spearman == pytest.approx(pd.Series(p).rank().corr(pd.Series(a).rank()))
    pos, neg = p[a > 0], p[a <= 0]
    assert m.roc_auc == pytest.approx(np.mean([(x > y) + 0.5 * (x == y) for x in pos for y in neg]))
    q = np.quantile(p, [0.2, 0.8])
    assert m.top_minus_bottom == pytest.approx(a[p >= q[1]].mean() - a[p <= q[0]].mean())
    assert got["flat"].pearson is None and got["flat"].roc_auc is None and got["flat"].n == 10
    few = evaluation.group_metrics(predictions(spark, rows[:4]), ["model"]).first()
    assert few.n == 4 and few.mae is None
    low, high = evaluation.block_bootstrap(predictions(spark, rows), ["model"], ["event_id"]).where("model = 'm'").select("low", "high").first()
    assert low < m.pearson < high
    assert evaluation.group_metrics(predictions(spark, []), ["model"]).collect() == []


def test_tone(spark):
    df = spark.createDataFrame([(1, "Strong  GROWTH but weak\xa0risk, 3rd"), (2, None), (3, "   "), (4, "uncertainty uncertainty")], "id int, text string")
    got = {r.id: r for r in tone.tone_scores(df, "text").collect()}
    assert got[1].n_tokens == 6 and got[1].pos_freq == pytest.approx(2 / 6) and got[1].neg_freq == pytest.approx(1 / 6) and got[1].numerical_density == pytest.approx(1 / 6)
    assert got[2].n_tokens == 0 == got[3].pos_freq and got[4].neg_freq == 1 == got[4].uncertainty_freq


def test_contracts(spark):
    contract = integrity.Contract(T.StructType([T.StructField("id", T.LongType(), False), T.StructField("kind", T.StringType())]), {"kind": ["a", "b"]}, ("id",))
    good = spark.createDataFrame([("1", "a", 0.0), ("2", None, 1.0)], "id string, kind string, extra double")
    assert integrity.validate(good, contract).dtypes == [("id", "bigint"), ("kind", "string"), ("extra", "double")]
    with pytest.raises(ValueError, match="allowed kind: 1; unique id: 1"):
        integrity.validate(spark.createDataFrame([(1, "totally_made_up"), (1, "a")], "id long, kind string"), contract)
    with pytest.raises(ValueError, match="missing columns: kind"):
        integrity.conform(good.drop("kind"), contract)
    assert {r.violations for r in integrity.contract_report(good.limit(0), contract).collect()} == {0}


def test_integrity_predicates_take_null_for_no_violation(spark):
    t = datetime(2020, 1, 1)
    rows = spark.createDataFrame([("a", t, t, t), ("b", None, t, t), ("c", datetime(2019, 1, 1), t, t)], "event_id string, feature_available_at timestamp, order_submission_cutoff timestamp, prediction_timestamp timestamp")
    assert [r.event_id for r in integrity.late_features(rows).collect()] == ["a"] and integrity.late_features(rows, False).count() == 0
    assert [r.event_id for r in integrity.labelled_too_late(rows, rows).collect()] == ["a"]


def test_security_versions(spark):
    d = date.fromisoformat
    rows = [("A", 1, d("2020-01-01"), None, datetime(2020, 1, 2), 3e9), ("A", 2, d("2021-01-01"), None, datetime(2021, 1, 2), 1e10), ("A", 3, d("2021-01-01"), None, datetime(2021, 1, 2), 5.0), ("B", 4, d("2020-01-01"), d("2020-06-01"), datetime(2020, 1, 2), None), (None, 5, d("2020-01-01"), None, datetime(2020, 1, 2), 1.0)]
    master = spark.createDataFrame(rows, "security_id string, version_id long, valid_at date, delisting_date date, recorded_at timestamp, size double")
    on = lambda s: F.lit(s).cast("date")
    assert sorted(r.version_id for r in securities.valid_versions(master, on("2021-06-01")).collect()) == [1, 2, 3]
    assert [tuple(r) for r in securities.latest_versions(master, on("2021-06-01"), ["version_id"]).collect()] == [("A", 2)]
    assert sorted(map(tuple, securities.latest_versions(master, on("2020-05-31"), ["version_id"]).collect())) == [("A", 1), ("B", 4)]
    assert [r.b for r in master.orderBy("version_id").select(securities.cap_bucket("size").alias("b")).collect()] == ["mid_cap", "large_cap", "small_cap", None, "small_cap"]
    contract = integrity.Contract(T.StructType([T.StructField("security_id", T.StringType()), T.StructField("valid_at", T.DateType())]), unique=("security_id", "valid_at"))
    with pytest.raises(ValueError, match="unique"):
        securities.check_master(master, contract)
    securities.check_master(master.where("version_id <> 3"), contract)
