"""Integrity predicates (rows that violate; empty is a pass) and table contracts.

Defined cases: a comparison with null is no violation; a contract on a table that lacks a
required column raises; an empty table keeps every contract.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def late_features(features: DataFrame, strict: bool = True) -> DataFrame:
    """Features available at or after the cutoff (after the prediction, if not strict)."""
    return features.where("feature_available_at >= order_submission_cutoff" if strict else "feature_available_at > prediction_timestamp")


def late_estimates(events: DataFrame) -> DataFrame:
    return events.where("estimate_timestamp >= announcement_timestamp")


def late_filings(features: DataFrame, events: DataFrame) -> DataFrame:
    """Features whose event's filing came at or after the prediction."""
    return features.join(events.select("event_id", "filing_timestamp"), "event_id").where("filing_timestamp >= prediction_timestamp")


def labelled_too_late(features: DataFrame, labels: DataFrame) -> DataFrame:
    """Features of labelled events that are not available before the prediction."""
    return features.join(labels.select("event_id"), "event_id", "left_semi").where("feature_available_at >= prediction_timestamp")


@dataclass(frozen=True)
class Contract:
    """Required columns with types, which of them may be null, and allowed values."""

    columns: T.StructType
    allowed: dict[str, list[str]] = field(default_factory=dict)
    unique: tuple[str, ...] = ()


def conform(df: DataFrame, contract: Contract) -> DataFrame:
    """The table with required columns cast to their types; other columns stay. Raises if one is missing."""
    missing = [f.name for f in contract.columns if f.name not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.withColumns({f.name: F.col(f.name).cast(f.dataType) for f in contract.columns})


def contract_report(df: DataFrame, contract: Contract) -> DataFrame:
    """One row per rule: rule, column, violations. One pass over the data, one more per unique key."""
    checked = conform(df, contract)
    rules = [("not_null", f.name, F.col(f.name).isNull()) for f in contract.columns if not f.nullable]
    rules += [("allowed", c, F.col(c).isNotNull() & ~F.col(c).isin(*v)) for c, v in contract.allowed.items()]
    if not rules:
        report = df.sparkSession.createDataFrame([], "rule string, column string, violations long")
        return with_unique(report, checked, contract)
    counts = checked.agg(*[F.count_if(bad).alias(str(i)) for i, (_, _, bad) in enumerate(rules)])
    rows = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(c).alias("column"), F.col(str(i)).alias("violations")) for i, (r, c, _) in enumerate(rules)]))
    return with_unique(counts.select(rows.alias("x")).select("x.*"), checked, contract)


def with_unique(report: DataFrame, checked: DataFrame, contract: Contract) -> DataFrame:
    if contract.unique:
        extra = checked.groupBy(*contract.unique).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("violations"))
        report = report.unionByName(extra.select(F.lit("unique").alias("rule"), F.lit(",".join(contract.unique)).alias("column"), "violations"))
    return report


def validate(df: DataFrame, contract: Contract) -> DataFrame:
    """The conformed table; raises if a rule is broken."""
    broken = contract_report(df, contract).where("violations > 0").collect()  # at most one row per rule
    if broken:
        raise ValueError("; ".join(f"{r['rule']} {r['column']}: {r['violations']}" for r in broken))
    return conform(df, contract)
