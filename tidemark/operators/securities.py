"""Security master operators: size buckets, versions valid on a day, key checks.

Defined cases: a null size has no bucket; a version without delisting date is open-ended;
versions without key or validity are left out; ties go to the latest recording, then the smallest version.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.integrity import Contract, contract_report

#: Lower bounds of the size buckets in dollars (parameters).
LARGE, MID = 1e10, 2e9


def cap_bucket(size: Column | str, large: float = LARGE, mid: float = MID) -> Column:
    c = F.col(size) if isinstance(size, str) else size
    return F.when(c >= large, "large_cap").when(c >= mid, "mid_cap").when(c.isNotNull(), "small_cap")


def build_master(listed: DataFrame) -> DataFrame:
    """One version per listed security (columns of ``listed``: security_id, ticker, cik, company_name, sector, industry, market_cap, listing_date), valid from its listing."""
    return listed.select(
        "security_id", "ticker", "cik", "company_name", "sector", "industry", F.col("market_cap").alias("market_cap_usd"), cap_bucket("market_cap").alias("cap_bucket"), F.col("listing_date").alias("valid_at"),
        "listing_date", F.lit(None).cast("date").alias("delisting_date"),
    )


def valid_versions(master: DataFrame, day: Column) -> DataFrame:
    """Versions valid on a day, all of a key if several overlap."""
    listed = F.col("delisting_date").isNull() | (F.col("delisting_date") > day)
    return master.where((F.col("valid_at") <= day) & listed & F.col("security_id").isNotNull())


def latest_versions(master: DataFrame, day: Column, columns: list[str]) -> DataFrame:
    """security_id and ``columns`` of its one version valid on a day: the latest valid one."""
    best = F.max_by(F.struct(*columns), F.struct("valid_at", "recorded_at", -F.col("version_id"))).alias("v")
    return valid_versions(master, day).groupBy("security_id").agg(best).select("security_id", *[f"v.{c}" for c in columns])


def check_master(master: DataFrame, contract: Contract) -> None:
    """Raises if columns are missing or a (security, validity) comes twice."""
    broken = contract_report(master, contract).where("violations > 0").collect()  # a row per rule
    if broken:
        raise ValueError("; ".join(f"{r['rule']} {r['column']}: {r['violations']}" for r in broken))
