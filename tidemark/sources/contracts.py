"""Contracts of the study's tables: required columns with types, which may be null, allowed values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.integrity import Contract, contract_report

TEXT, NUMBER, DAY, STAMP = T.StringType(), T.DoubleType(), T.DateType(), T.TimestampType()


def made(required: dict[str, T.DataType], optional: dict[str, T.DataType] | None = None, **allowed: list[str]) -> Contract:
    fields = [T.StructField(n, t, False) for n, t in required.items()] + [T.StructField(n, t, True) for n, t in (optional or {}).items()]
    return Contract(T.StructType(fields), allowed)


#: Names of the columns (fixed values: the tables that users of such studies exchange).
CONTRACTS: dict[str, Contract] = {
    "events": made(
        {"event_id": TEXT, "security_id": TEXT, "ticker": TEXT, "announcement_timestamp": STAMP, "timing_class": TEXT, "fiscal_period_end": DAY},
        {"actual_eps": NUMBER, "estimated_eps": NUMBER, "actual_revenue": NUMBER, "estimated_revenue": NUMBER, "estimate_timestamp": STAMP, "filing_timestamp": STAMP},
        timing_class=["before_market_open", "after_market_close", "intraday", "unknown"],
    ),
    "prices": made({"date": DAY, "open": NUMBER, "high": NUMBER, "low": NUMBER, "close": NUMBER, "volume": NUMBER}),
    "estimates": made({"event_id": TEXT, "security_id": TEXT, "estimate_timestamp": STAMP}, {"estimated_eps": NUMBER, "estimated_revenue": NUMBER}),
    "filings": made({"filing_accession_number": TEXT, "event_id": TEXT, "filing_timestamp": STAMP, "text": TEXT}),
    "event_master": made(
        {"event_id": TEXT, "security_id": TEXT, "effective_trading_date": DAY, "entry_session": DAY, "timing_class": TEXT}, {"prediction_timestamp": STAMP, "order_submission_cutoff": STAMP, "exclusion_reason": TEXT}
    ),
    "features": made({"event_id": TEXT, "security_id": TEXT, "prediction_timestamp": STAMP, "feature_available_at": STAMP, "source_available_at": STAMP}),
    "labels": made(
        {"event_id": TEXT},
        dict.fromkeys(
            ["reaction_car", "reaction_car_market_adj", "reaction_car_sector_adj", "drift_car_20", "drift_car_20_market_adj", "drift_car_20_sector_adj", "realized_vol_20", "realized_vol_20_annualized"], NUMBER
        ),
    ),
}


def table_report(tables: dict[str, DataFrame]) -> DataFrame:
    """table_name, rule, column, violations of each named table against its contract. A column that is missing is a violation of 'present'."""
    parts = []
    for name, df in tables.items():
        contract = CONTRACTS[name]
        missing = [f.name for f in contract.columns if f.name not in df.columns]
        held = Contract(T.StructType([f for f in contract.columns if f.name not in missing]), {c: v for c, v in contract.allowed.items() if c not in missing}, contract.unique)
        parts.append(contract_report(df, held).withColumn("table_name", F.lit(name)))
        if missing:
            parts.append(df.sparkSession.createDataFrame([("present", c, 1, name) for c in missing], parts[0].schema))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("table_name", "rule", "column", "violations")
