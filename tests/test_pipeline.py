import os

import pytest
from pyspark.sql import functions as F

from tidemark.cli import main, parser
from tidemark.config import load_config
from tidemark.operators import models
from tidemark.plans import reference
from tidemark.plans.pipeline import Study, render
from tidemark.sources.contracts import table_report
from tidemark.sources.io import PROVIDERS, fetch, file_hash, read_cases, read_table, row_hash, write_table


@pytest.fixture(scope="module")
def study(spark, tmp_path_factory):
    config = load_config(base__output=str(tmp_path_factory.mktemp("study")), base__stocks=12, base__start="2017-01-03", base__end="2021-12-31", features__text=True, walkforward__train_start="2017-01-01", walkforward__train_end="2018-12-31", walkforward__last_end="2020-12-31")
    s = Study(spark, config)
    s.ingest()
    s.build_events()
    s.build_features()
    s.build_labels()
    return s


LINEAR = models.standard_models()[:1]


def test_steps(study):
    events = study.validate_events()
    assert events["events"] == 12 * 4 * 4 and not any(v for k, v in events["failures"].items() if k != "bmo_same_session_ok")
    assert study.validate_features()["late_features"] == 0
    assert study.table("text_features").count() > 0
    report = {r["model"]: r for r in study.train(trained=LINEAR)}
    assert report["surprise"]["pearson"] > 0.4 and report["linear"]["pearson"] > 0.4 and abs(report["prior"]["pearson"]) < 0.4
    assert report["event_day_unconditional"]["n"] == report["unconditional_mean"]["n"]
    assert report["surprise"]["low"] < report["surprise"]["pearson"] < report["surprise"]["high"]
    book = study.backtest("surprise")
    for horizon in ("reaction", "drift"):
        sweep = book[horizon]["sweep"]
        assert len(sweep) == 6 and sweep[-1]["spread_net"] == pytest.approx(sweep[0]["spread_net"] - 2 * 0.005)
        assert book[horizon]["primary"][0]["turnover"] == 1.0 and {r["year"] for r in book[horizon]["by_year"]} == {2020}
    assert book["reaction"]["sweep"] != book["drift"]["sweep"]
    ablated = study.ablate(trained=[], least=0)
    assert ablated["surprise_only"]["surprise"]["pearson"] > 0.4 and ablated["no_sector"]["surprise"]["low"] is not None
    assert set(study.ablate(trained=[], least=10**6)["large_cap"]) == {"skipped"}
    with open(study.report(), encoding="utf-8") as file:
        page = file.read()
    assert "train_reaction_car" in page and "backtest_surprise_reaction_car" in page


def test_contracts_are_enforced_where_tables_are_made(study):
    broken = study.table("events").withColumn("timing_class", F.lit("totally_made_up"))
    with pytest.raises(ValueError, match="allowed timing_class"):
        study.store("broken", broken, "events")
    with pytest.raises(ValueError, match="missing columns: feature_available_at"):
        study.store("broken", study.table("features").drop("feature_available_at"), "features")
    kept = {"events": "events", "bars": "prices", "estimates": "estimates", "filings": "filings", "event_master": "event_master", "features": "features", "labels": "labels"}
    report = table_report({c: study.table(t) for t, c in kept.items()})
    assert {r.violations for r in report.collect()} == {0}
    assert ("events", "present", "ticker", 1) in set(map(tuple, table_report({"events": study.table("events").drop("ticker")}).collect()))


def test_known_cases(study, tmp_path):
    """Facts: after-close and before-open announcements before a session, a weekend and a holiday."""
    path = tmp_path / "cases.csv"
    path.write_text(
        "ticker,company_name,announcement_timestamp,timing_class,expected_effective_date,notes\n"
        "AAPL,Apple,2020-01-28 16:30:00,after_market_close,2020-01-29,\nAMZN,Amazon,2020-10-30 16:00:00,after_market_close,2020-11-02,Friday\nJPM,JPMorgan,2020-01-14 06:45:00,before_market_open,2020-01-14,\n"
        "JPM,JPMorgan,2020-01-14 06:45:00,before_market_open,2020-01-14,again\nAAA,Holiday,2020-09-04 16:05:00,after_market_close,2020-09-08,Labor Day\nBBB,Saturday,2020-02-01 08:00:00,before_market_open,2020-02-03,\n"
    )
    study.config.base["golden"] = str(path)
    try:
        assert study.validate_events()["golden"] == {"n": 6, "effective_date_accuracy": 1.0, "timing_valid_rate": 1.0, "duplicate_rate": pytest.approx(1 / 6)}
        path.write_text("ticker,announcement_timestamp,timing_class,expected_effective_date\nA,2020-01-28 16:30:00,sometime,2020-01-28\n")
        assert study.validate_events()["golden"] == {"n": 1, "effective_date_accuracy": 0.0, "timing_valid_rate": 0.0, "duplicate_rate": 0.0}
    finally:
        study.config.base["golden"] = ""


def test_all_eight_labels_are_planted(study):
    got = study.table("labels").join(study.table("events").select("event_id", "planted_reaction", "planted_drift", "planted_volatility"), "event_id")
    for column, planted in (("reaction_car", "planted_reaction"), ("reaction_car_sector_adj", "planted_reaction"), ("drift_car_20_market_adj", "planted_drift"), ("realized_vol_20", "planted_volatility")):
        assert got.where(~F.col(column).eqNullSafe(F.col(planted))).isEmpty(), column
    assert {"planted_volatility"} <= set(study.table("events").columns) and study.table("security_master").count() == 12


def test_planted_signal_fades_and_volatile_small_ones_react_more(spark):
    events = fetch("synthetic", spark, stocks=200, start="2015-01-02", end="2025-12-31")["events"]
    slope = lambda df: df.select(F.regr_slope("planted_reaction", "surprise_pct")).first()[0]
    assert slope(events.where("fiscal_year < 2017")) > 1.05 * slope(events.where("fiscal_year > 2022"))
    assert slope(events.where("cap_bucket = 'small_cap'")) > 1.4 * slope(events.where("cap_bucket = 'large_cap'"))
    assert slope(events.where("annual_vol >= 0.4")) > slope(events.where("annual_vol < 0.4"))


def test_negative_control(spark):
    tables = fetch("synthetic", spark, stocks=40, start="2018-01-02", end="2020-12-31", signal=0.0)
    got = tables["events"].select(F.corr(F.col("actual_eps") / F.col("estimated_eps"), "planted_reaction")).first()[0]
    assert abs(got) < 0.15


def test_synthetic_does_not_depend_on_partitions(spark):
    a = fetch("synthetic", spark, stocks=3, start="2020-01-02", end="2021-03-31")["bars"]
    one = {tuple(r) for r in a.collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        assert {tuple(r) for r in fetch("synthetic", spark, stocks=3, start="2020-01-02", end="2021-03-31")["bars"].collect()} == one
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_a_failing_model_is_reported_and_the_rest_go_on(study):
    def broken(_):
        raise RuntimeError("no luck")

    got, failed = models.walk_forward(study.members("reaction_car"), "target", [models.Trained("broken", broken), *LINEAR])
    assert {f[0] for f in failed} == {"broken"} and {r.model for r in got.select("model").distinct().collect()} == {"linear"}


def test_elastic_net_without_penalty_is_linear(study):
    members = study.members("reaction_car")
    got, failed = models.walk_forward(members, "target", [*LINEAR, models.Trained("free", models.elastic_net(0.0, 0.5))])
    wide = got.groupBy("fold", "event_id").pivot("model", ["linear", "free"]).agg(F.first("prediction"))
    assert not failed and wide.agg(F.max(F.abs(F.col("linear") - F.col("free")))).first()[0] < 1e-3


def test_trees_recover_the_signal(study):
    members = study.members("reaction_car")
    got, failed = models.walk_forward(members, "target", [models.standard_models(20, 5)[2]])
    assert not failed and got.select(F.corr("prediction", "actual")).first()[0] > 0.4


def sizes(trained):
    made = {m.name: m.make(None) for m in trained if m.name != "elastic_net"}
    return made["random_forest"].getNumTrees() if "random_forest" in made else None, made["boosted_trees"].getMaxIter() if "boosted_trees" in made else None


def test_queries_and_study_train_the_full_models(spark, study, monkeypatch):
    used = []
    monkeypatch.setattr(reference, "modelled", lambda spark, folder, model: used.append(model) or spark.range(1))
    for name in ("model_random_forest", "model_boosted_trees"):
        reference.QUERIES[name](spark, "")
    assert sizes(used) == (200, 300)
    seen = []
    monkeypatch.setattr(study, "predict", lambda members, trained, columns=None: seen.append((members, trained)) or (_ for _ in ()).throw(InterruptedError))
    with pytest.raises(InterruptedError):
        study.train()
    members, trained = seen[0]
    assert len(trained) == 4 and sizes(trained) == (200, 300)
    assert len(models.NUMERIC) == 16 and set(models.NUMERIC) <= set(members.columns)


def test_ablation_runs_all_models_over_all_groups(study, monkeypatch):
    runs, schema, table = [], "model string, fold string, event_id string, prediction double, actual double", study.table

    def predict(rows, trained, columns=None):
        runs.append((rows, [m.name for m in trained]))
        return study.spark.createDataFrame([], schema), []

    monkeypatch.setattr(study, "predict", predict)
    monkeypatch.setattr(study, "table", lambda name: study.spark.createDataFrame([], schema) if name.startswith("predictions_") else table(name))
    os.makedirs(study.path("metrics"), exist_ok=True)
    report = study.ablate(least=0)
    assert set(report) == {"surprise_only", "market_only", "no_sector", "no_momentum", "no_valuation", "exclude_2020", "large_cap", "mid_cap", "small_cap", "decay"}
    assert [names for _, names in runs] == [["linear", "elastic_net", "random_forest", "boosted_trees"]] * 9
    by = {name: rows for name, (rows, _) in zip([n for n in report if n != "decay"], runs)}
    assert not {"market_cap_at_event", "dist_high"} & set(by["no_valuation"].columns)
    assert by["no_sector"].where("sector is not null").isEmpty()


def test_no_shuffling_splitters_in_the_library():
    root = os.path.dirname(os.path.dirname(models.__file__))
    for folder, _, names in os.walk(root):
        for name in names:
            if name.endswith(".py"):
                with open(os.path.join(folder, name), encoding="utf-8") as file:
                    assert models.shuffling_calls(file.read()) == [], name
    assert models.shuffling_calls("a.randomSplit([1, 2]); KFold(3); x.fit()") == ["KFold", "randomSplit"]


def test_config():
    a = load_config()
    assert a.digest() == load_config().digest() != load_config(base__seed=1).digest()
    for bad in ({"nowhere__x": 1}, {"base__nothing": 1}):
        with pytest.raises(KeyError):
            load_config(**bad)


def test_default_universe_is_the_whole_study():
    assert load_config().base["stocks"] == 100


def test_config_files(tmp_path):
    (tmp_path / "base.yaml").write_text("seed: 7\n")
    assert load_config(str(tmp_path)).base["seed"] == 7


def test_cli(capsys):
    assert main(["inspect"]) == 0 and "zone" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        parser().parse_args(["nonsense"])


def test_formats_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 2.5), (2, None, None)], "i int, s string, d double")
    for kind in ("parquet", "orc", "csv", "json"):
        path = str(tmp_path / kind)
        write_table(df, path, kind, files=1)
        assert sorted(map(tuple, read_table(spark, path, kind, df.schema).collect())) == [(1, "a", 2.5), (2, None, None)]
    write_table(df, str(tmp_path / "by"), by=["i"])
    assert sorted(os.listdir(tmp_path / "by"))[-2:] == ["i=1", "i=2"]
    for args in (("x", "weird"), ("x", "csv")):
        with pytest.raises(ValueError):
            read_table(spark, *args)
    assert read_cases(spark, str(tmp_path / "none.csv")).count() == 0
    (tmp_path / "cases.csv").write_text("ticker,announcement_timestamp,timing_class,expected_effective_date\nAAPL,2020-01-28 16:30:00,after_market_close,2020-01-29\n")
    assert str(read_cases(spark, str(tmp_path / "cases.csv")).select(F.date_format("announcement_timestamp", "HH:mm")).first()[0]) == "21:30"
    assert len(file_hash(str(tmp_path / "cases.csv"))) == 16
    assert row_hash(df, ["i", "s"]).select("row_hash").distinct().count() == 2


def test_providers(spark):
    assert {"synthetic", "folder"} <= set(PROVIDERS)
    with pytest.raises(ValueError):
        fetch("nowhere", spark)


def test_render():
    assert render([{"a": 1, "b": "<x>"}]) == "<table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>&lt;x&gt;</td></tr></table>"
