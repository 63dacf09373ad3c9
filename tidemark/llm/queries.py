"""The pN_ queries of this subpackage, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.keys import norm_key
from tidemark.llm.consensus import Survivor, near_groups, surviving_fields
from tidemark.llm.encode import encode_corpus
from tidemark.llm.pack import fill_containers
from tidemark.llm.quality import STATS, text_statistics, text_types
from tidemark.session import shared_folder
from tidemark.sources.tables import table

#: Values that cannot be meant (parameters): earnings per share beyond these, revenue not above 0 or of a
#: quadrillion, times outside the years in which a feed can have been written.
EPS_LIMIT, REVENUE_LIMIT, YEARS = 900.0, 1e14, ("1971-01-01", "2090-01-01")


def real_number(name: str, low: float, high: float) -> Column:
    return F.col(name).isNotNull() & ~F.isnan(name) & (F.col(name) > low) & (F.col(name) < high)


def real_time(name: str) -> Column:
    return (F.col(name) > F.lit(YEARS[0]).cast("timestamp")) & (F.col(name) < F.lit(YEARS[1]).cast("timestamp"))


FIELDS = ["announcement_timestamp", "filing_timestamp", "actual_eps", "estimated_eps", "actual_revenue", "estimated_revenue"]


def p4_settled(spark: SparkSession, folder: str, decay: float | None = 0.5) -> DataFrame:
    rows = table(spark, folder, "announcements", "event_id", "security_id", "fiscal_period_end", "source", "ingestion_timestamp", "deleted_at", *FIELDS).where("deleted_at is null")
    feeds = table(spark, folder, "feed_sources", "source", "trust")
    grouped = near_groups(rows.withColumn("security_id", norm_key("security_id")).join(feeds, "source", "left"), "security_id", "fiscal_period_end", "event_id")
    fields = [Survivor(f, real_time(f)) for f in FIELDS[:2]]
    fields += [Survivor(f, real_number(f, -EPS_LIMIT, EPS_LIMIT)) for f in FIELDS[2:4]]
    fields += [Survivor(f, real_number(f, 0.0, REVENUE_LIMIT)) for f in FIELDS[4:]]
    return surviving_fields(grouped, "event_id", "trust", "ingestion_timestamp", fields, decay=decay)


def p4_survivors(spark: SparkSession, folder: str, decay: float | None = 0.5) -> DataFrame:
    """As ``p4_found``, with the surviving values: instants to the microsecond, numbers to six places."""
    instant = F.date_format(F.col("value").try_cast("timestamp"), "yyyy-MM-dd HH:mm:ss.SSSSSS")
    number = F.format_string("%.6f", F.col("value").try_cast("double"))
    return p4_settled(spark, folder, decay).withColumn("value", F.when(F.col("field_name").isin(*FIELDS[:2]), instant).otherwise(number))


def p4_consensus(spark: SparkSession, folder: str) -> DataFrame:
    """Survivors by votes instead of trust: every record has one vote, so values that agree token by token win."""
    return p4_survivors(spark, folder, None)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return p4_settled(spark, folder).select("group_id", "field_name", "event_id")


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode_corpus(table(spark, folder, "documents"))


def p9_containers(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    lengths = encode_corpus(documents, lengths_only=True)
    return fill_containers(lengths, expected=documents.count())


def p10_statistics(spark: SparkSession, folder: str) -> DataFrame:
    return text_statistics(table(spark, folder, "documents")).select("doc_id", *STATS)


def p10_words(spark: SparkSession, folder: str) -> DataFrame:
    """Counts among the statistics that SQL can express."""
    got = p10_statistics(spark, folder)
    return got.select("doc_id", *[F.round(c, 8).alias(c) for c in ("words", "word_length", "lines", "words_per_line")])


def p10_types(spark: SparkSession, folder: str) -> DataFrame:
    # read twice (patterns, then types), so the votes are kept in the shared folder
    shared_folder(spark)
    measured = text_statistics(table(spark, folder, "documents")).select("doc_id", "votes").checkpoint()
    return text_types(measured)


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return p10_types(spark, folder).where("kind <> 'prose'").select("doc_id", "kind")


KEY = "nullif(upper(trim(security_id, ' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11) || chr(160))), '')"
REAL = {f: f"{f} > TIMESTAMPTZ '{YEARS[0]} 00:00:00+00' AND {f} < TIMESTAMPTZ '{YEARS[1]} 00:00:00+00'" for f in FIELDS[:2]}
REAL |= {f: f"{f} > -{EPS_LIMIT} AND {f} < {EPS_LIMIT}" for f in FIELDS[2:4]}
REAL |= {f: f"{f} > 0 AND {f} < {REVENUE_LIMIT}" for f in FIELDS[4:]}
VALUE = {f: f"strftime({f} AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S.%f')" for f in FIELDS[:2]} | {f: f"printf('%.6f', {f})" for f in FIELDS[2:]}
P4_GROUPS = f"""
WITH a AS (SELECT *, {KEY} AS s FROM announcements WHERE deleted_at IS NULL),
c AS (SELECT *, CASE WHEN fiscal_period_end - lag(fiscal_period_end) OVER w <= 7 THEN 0 ELSE 1 END AS fresh FROM a
  WHERE s IS NOT NULL AND fiscal_period_end IS NOT NULL WINDOW w AS (PARTITION BY s ORDER BY fiscal_period_end)),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY s ORDER BY fiscal_period_end, fresh DESC ROWS UNBOUNDED PRECEDING) AS run FROM c),
g AS (SELECT *, min(event_id) OVER (PARTITION BY s, run) AS group_id, count(*) OVER (PARTITION BY s, run) AS n FROM r)
"""


def p4_sql(*columns: str) -> str:
    """The most trusted real value of each field; ``columns`` besides the group and the field."""
    return P4_GROUPS + " UNION ALL ".join(
        f"SELECT group_id, '{f}' AS field_name, {', '.join(columns)} FROM (SELECT group_id, event_id, {VALUE[f]} AS value, row_number() OVER (PARTITION BY s, run ORDER BY coalesce(f.trust, 1000000), ingestion_timestamp DESC, event_id) AS rn "
        f"FROM g LEFT JOIN feed_sources f ON f.source = g.source WHERE n >= 2 AND {REAL[f]}) WHERE rn = 1"
        for f in FIELDS
    )


BLANK = r"\t\n\x0b\x0c\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
P10_WORDS = rf"""
WITH t AS (SELECT doc_id, len(regexp_extract_all(text, '[^{BLANK}]+')) AS w, length(regexp_replace(text, '[{BLANK}]+', '', 'g')) AS c,
  len(list_filter(regexp_split_to_array(text, '[\r\n\x0b\x0c\x{{85}}\x{{2028}}\x{{2029}}]+'), lambda x: regexp_matches(x, '[^{BLANK}]'))) AS k FROM documents)
SELECT doc_id, CASE WHEN w > 0 THEN w::DOUBLE END AS words, CASE WHEN w > 0 THEN round(c / w::DOUBLE, 8) END AS word_length, CASE WHEN w > 0 THEN k::DOUBLE END AS lines, CASE WHEN w > 0 THEN round(w / k::DOUBLE, 8) END AS words_per_line FROM t
"""

QUERIES = {"p4_found": p4_found, "p4_survivors": p4_survivors, "p4_consensus": p4_consensus, "p8_ids": p8_ids, "p9_containers": p9_containers, "p10_found": p10_found, "p10_statistics": p10_statistics, "p10_words": p10_words}
SQL = {"p4_found": p4_sql("event_id"), "p4_survivors": p4_sql("event_id", "value"), "p10_words": P10_WORDS}
