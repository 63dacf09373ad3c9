"""The whole study as steps over stored tables: ingest, align, features, labels, train, sweep, report."""

from __future__ import annotations

import html
import logging
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import Config
from tidemark.operators import alignment, evaluation, features, integrity, labels, models, ranks, tone
from tidemark.operators import calendar as cal
from tidemark.sources import synthetic  # noqa: F401 - registers its provider
from tidemark.sources.contracts import CONTRACTS
from tidemark.sources.io import fetch, read_cases, read_json, read_table, write_json, write_table

log = logging.getLogger("tidemark")
BASELINES = ["unconditional_mean", "surprise", "prior", "surprise_decile", "sector_relative", "event_day_unconditional"]
GROUPS = {
    "surprise_only": ["eps_surprise", "eps_surprise_pct", "rev_surprise_pct", "sue", "beat", "beat_streak", "prev_surprise_pct"],
    "market_only": features.MARKET,
}
SUMMARY = ["n_total", "pearson", "low", "high", "top_minus_bottom", "roc_auc", "ece", "effect_size"]
ALWAYS = ["event_id", "security_id", "sector", "cap_bucket", "fold", "role", "eps_surprise_pct", "prev_surprise_pct", "target"]


class Study:
    """Steps of one study; each reads and writes tables under the output folder, so a run can stop and go on."""

    def __init__(self, spark: SparkSession, config: Config):
        self.spark, self.config, self.out = spark, config, config.base["output"]

    def path(self, *parts: str) -> str:
        return os.path.join(self.out, *parts)

    def table(self, name: str) -> DataFrame:
        return read_table(self.spark, self.path("tables", name))

    def store(self, name: str, df: DataFrame, contract: str | None = None) -> None:
        """Writes a table; one that breaks its contract raises (it is read back for that, so it isn't computed twice)."""
        write_table(df, self.path("tables", name))
        if contract:
            integrity.validate(self.table(name), CONTRACTS[contract])

    def ingest(self) -> dict:
        base = self.config.base
        options = {"folder": base["folder"]} if base["provider"] == "folder" else {"stocks": base["stocks"], "start": base["start"], "end": base["end"], "seed": base["seed"], "signal": base["signal"]}
        counts = {}
        for name, df in fetch(base["provider"], self.spark, **options).items():
            self.store(name, df, {"bars": "prices"}.get(name, name if name in ("events", "estimates", "filings") else None))
            counts[name] = self.table(name).count()
        write_json({"provider": base["provider"], "rows": counts, "config": self.config.digest()}, self.path("metrics", "ingest.json"))
        return counts

    def days(self) -> DataFrame:
        return cal.day_table(self.table("sessions"))

    def build_events(self) -> None:
        label = self.config.labels
        master = alignment.event_master(self.table("events"), self.days(), self.table("sessions"), label["reaction"], label["drift"])
        self.store("event_master", master.withColumn("effective_trading_date", F.col("effective_date")), "event_master")

    def validate_events(self) -> dict:
        master = self.table("event_master")
        checks = alignment.alignment_report(master, self.days())
        bad = checks.agg(*[F.count_if(~F.col(c)).alias(c) for c in checks.columns if c != "event_id"]).first().asDict()
        excluded = {r["exclusion_reason"]: r["count"] for r in master.groupBy("exclusion_reason").count().collect()}
        report = {"events": master.count(), "failures": bad, "exclusions": excluded, "late_estimates": integrity.late_estimates(master).count()}
        if self.config.base["golden"]:
            cases = read_cases(self.spark, self.config.base["golden"], self.config.base["zone"])
            report["golden"] = alignment.golden_report(cases, self.days()).first().asDict()
            if (report["golden"]["effective_date_accuracy"] or 0) < 0.98:
                log.warning("effective dates of known cases are right in %s only", report["golden"]["effective_date_accuracy"])
        write_json(report, self.path("metrics", "events.json"))
        return report

    def build_features(self) -> None:
        windows = {k: v for k, v in self.config.features.items() if k != "text"}
        primary = alignment.primary(self.table("event_master"))
        base = features.surprises(primary)
        full = base.join(features.market_context(primary, self.table("bars"), **windows), "event_id", "left")
        full = ranks.bucketed(full, ["fiscal_year"], "market_cap_at_event", "event_id", 3, "liquidity_bucket")
        full = cal.with_day(full, "effective_date", self.days(), {"prev_session": "_prev"}).withColumns({"_market": cal.at_clock("_prev", 16, 5), "_cross": cal.at_clock("effective_date", 0, 0)})
        self.store("features", full.withColumn("feature_available_at", features.latest_availability(["announcement_timestamp", "_market", "_cross"])).withColumn("source_available_at", F.col("estimate_timestamp")).drop("_prev", "_market", "_cross"), "features")
        if self.config.features["text"]:
            known = primary.select("event_id", "security_id", "order_submission_cutoff").join(self.table("filings").drop("security_id"), "event_id").where("filing_timestamp < order_submission_cutoff")
            self.store("text_features", tone.tone_changes(tone.tone_scores(known, "text"), "security_id", "filing_timestamp", "event_id"))

    def validate_features(self) -> dict:
        rows = self.table("features")
        late = integrity.late_features(rows)
        sample = late.select("event_id", "feature_available_at", "order_submission_cutoff").orderBy("event_id").limit(5).collect()  # some to look at; all are counted
        report = {"rows": rows.count(), "late_features": late.count(), "violations_sample": [r.asDict() for r in sample]}
        write_json(report, self.path("metrics", "features.json"))
        if report["late_features"]:
            raise ValueError(f"{report['late_features']} features are available too late")
        return report

    def build_labels(self) -> None:
        primary, bars = alignment.primary(self.table("event_master")), self.table("bars")
        given = read_json(self.path("metrics", "ingest.json"))["rows"]
        market = self.table("benchmark") if "benchmark" in given else labels.average_bars(bars, [])
        sector = self.table("sector_bars") if "sector_bars" in given else labels.average_bars(bars, ["sector"])
        found = labels.return_labels(primary, bars, market.select("ord", "open", "close"), sector.select("sector", "ord", "open", "close"))
        found = found.join(labels.realized_volatility(primary, bars), "event_id")
        if self.config.labels["use_planted"] and "planted_reaction" in primary.columns:
            found = labels.override_planted(found, primary)
        self.store("labels", found, "labels")

    def folds(self) -> DataFrame:
        wf = self.config.walkforward
        return evaluation.make_folds(self.spark, *[wf[k] for k in ("train_start", "train_end", "val_start", "val_end", "test_start", "last_end")], wf["years"])

    def members(self, target: str, rows: DataFrame | None = None) -> DataFrame:
        labelled = (self.table("features") if rows is None else rows).join(self.table("labels").select("event_id", F.col(target).alias("target")), "event_id")
        return evaluation.fold_members(labelled, "effective_date", self.folds())

    def predict(self, members: DataFrame, trained: list[models.Trained], columns: list[str] | None = None) -> tuple[DataFrame, list]:
        got, failed = models.walk_forward(members, "target", trained, columns)
        for name in BASELINES:
            got = got.unionByName(evaluation.baseline_predictions(members, "target", name).withColumn("model", F.lit(name)))
        return got, failed

    def scored(self, predictions: DataFrame) -> list[dict]:
        """Pooled metrics with bootstrap intervals, a row per model."""
        interval = evaluation.block_bootstrap(predictions, ["model"], ["fold", "event_id"])
        return [r.asDict() for r in evaluation.pooled_metrics(predictions).join(interval, "model", "left").orderBy("model").collect()]

    def train(self, target: str = "reaction_car", trained: list[models.Trained] | None = None) -> list[dict]:
        got, failed = self.predict(self.members(target), models.standard_models() if trained is None else trained)
        self.store(f"predictions_{target}", got)
        report = self.scored(self.table(f"predictions_{target}"))
        write_json({"target": target, "models": report, "failed": failed}, self.path("metrics", f"train_{target}.json"))
        return report

    def backtest(self, model: str, target: str = "reaction_car") -> dict:
        """Per horizon, the returns from entry open to exit close of the events by bucket of their prediction: by level of deduction, at the primary level, per year."""
        book = self.config.portfolio
        n, level = book["buckets"], book["primary"]
        events = alignment.primary(self.table("event_master"))
        returns = labels.tradable_returns(events, self.table("bars"))
        told = self.table(f"predictions_{target}").where(F.col("model") == model)
        held = evaluation.positions(events, returns, told, {"reaction": "gross_reaction", "drift": "gross_drift"}, n).persist()
        parts = {
            "sweep": evaluation.scenario_sweep(held, "gross", "bucket", n, book["levels"], ["horizon"]).orderBy("level"), "primary": evaluation.book_summary(held, n, level, ["horizon"]),
            "by_year": evaluation.book_by_year(held, self.folds(), n, level, ["horizon"]).orderBy("year"),
        }
        report: dict = {"reaction": {}, "drift": {}}
        for part, df in parts.items():
            for row in df.collect():  # a row per horizon and level or year
                record = row.asDict()
                report[record.pop("horizon")].setdefault(part, []).append(record)
        held.unpersist()
        write_json({"model": model, "target": target} | report, self.path("metrics", f"backtest_{model}_{target}.json"))
        return report

    def ablate(self, target: str = "reaction_car", trained: list[models.Trained] | None = None, least: int = 100) -> dict:
        """Metrics of every model on subsets of features and of events. Size buckets need more than ``least`` events."""
        every = self.members(target)
        runs = {name: (models.feature_subset(every, keep, ALWAYS), keep) for name, keep in GROUPS.items()}
        runs["no_sector"] = (every.withColumn("sector", F.lit(None).cast("string")), None)
        runs["no_momentum"] = (every.drop("mom_1m", "mom_3m", "mom_6m"), None)
        runs["no_valuation"] = (every.drop("market_cap_at_event", "dist_high"), None)
        runs["exclude_2020"] = (every.where(F.year("effective_date") != 2020), None)
        report: dict = {}
        sizes = {r["cap_bucket"]: r["count"] for r in self.table("features").groupBy("cap_bucket").count().collect()}  # three buckets
        for cap in ("large_cap", "mid_cap", "small_cap"):
            if sizes.get(cap, 0) > least:
                runs[cap] = (every.where(F.col("cap_bucket") == cap), None)
            else:
                report[cap] = {"skipped": f"{sizes.get(cap, 0)} events"}
        for name, (rows, columns) in runs.items():
            got, failed = self.predict(rows, models.standard_models() if trained is None else trained, columns)
            self.store(f"ablation_{name}_{target}", got)
            report[name] = {r.pop("model"): {k: r[k] for k in SUMMARY} for r in self.scored(self.table(f"ablation_{name}_{target}"))}
            if failed:
                report[name]["failed"] = failed
        metrics = evaluation.group_metrics(self.table(f"predictions_{target}"), ["model", "fold"])
        report["decay"] = [r.asDict() for r in evaluation.decay_of_best(metrics).orderBy("fold").collect()]
        write_json(report, self.path("metrics", f"ablation_{target}.json"))
        return report

    def report(self) -> str:
        """An HTML page made only of the stored results."""
        parts = [f"<h1>Event study</h1><p>Configuration {self.config.digest()}</p>"]
        folder = self.path("metrics")
        for name in sorted(n for n in os.listdir(folder) if n.endswith(".json")):
            parts.append(f"<h2>{html.escape(name.removesuffix('.json'))}</h2>{render(read_json(os.path.join(folder, name)))}")
        page = self.path("report.html")
        with open(page, "w", encoding="utf-8") as file:
            file.write("<!doctype html><meta charset=utf-8><title>Event study</title><style>td,th{border:1px solid #ccc;padding:2px 6px}table{border-collapse:collapse}</style>" + "".join(parts))
        return page


def render(value: object) -> str:
    """A JSON value as HTML: lists of records as tables, objects as nested rows."""
    if isinstance(value, list) and value and all(isinstance(v, dict) for v in value):
        heads = list(dict.fromkeys(k for v in value for k in v))
        rows = "".join("<tr>" + "".join(f"<td>{render(v.get(h))}</td>" for h in heads) + "</tr>" for v in value)
        return "<table><tr>" + "".join(f"<th>{html.escape(h)}</th>" for h in heads) + f"</tr>{rows}</table>"
    if isinstance(value, dict):
        return "<table>" + "".join(f"<tr><th>{html.escape(str(k))}</th><td>{render(v)}</td></tr>" for k, v in value.items()) + "</table>"
    return html.escape(f"{value:.6g}" if isinstance(value, float) else str(value))
