"""Sources and sinks besides the parquet tables: formats, providers, provenance.

Defined cases: a missing optional CSV gives an empty table of its schema; a malformed row
is dropped and counted if asked; writing replaces what was there.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORMATS = ("parquet", "orc", "csv", "json", "text")


def read_table(spark: SparkSession, path: str, kind: str = "parquet", schema: T.StructType | None = None, **options: str) -> DataFrame:
    """Reads a table of one of FORMATS; text formats want a schema, so that nothing is inferred from the data."""
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind}")
    if kind in ("csv", "json") and schema is None:
        raise ValueError(f"{kind} needs a schema")
    reader = spark.read.options(**({"header": "true"} if kind == "csv" else {}) | options)
    return (reader.schema(schema) if schema is not None else reader).format(kind).load(path)


def write_table(df: DataFrame, path: str, kind: str = "parquet", by: list[str] | None = None, files: int | None = None, **options: str) -> None:
    """Writes a table, partitioned into folders by ``by`` (its rows are clustered by it first, so each folder gets few files)."""
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind}")
    out = df.repartition(*([files] if files else []), *by) if by else df.coalesce(files) if files else df
    writer = out.write.mode("overwrite").options(**({"header": "true"} if kind == "csv" else {}) | options)
    (writer.partitionBy(*by) if by else writer).format(kind).save(path)


def read_cases(spark: SparkSession, path: str, zone: str = "America/New_York") -> DataFrame:
    """Known cases from a CSV with a header (ticker, announcement_timestamp as wall time, timing_class, expected_effective_date; more columns are ignored); empty if there is no file. An unreadable stamp or day is null."""
    names = {"ticker": "string", "announcement_timestamp": "timestamp_ntz", "timing_class": "string", "expected_effective_date": "date"}
    rows = spark.read.csv(path, header=True) if os.path.exists(path) else spark.createDataFrame([], ", ".join(f"{n} string" for n in names))
    typed = rows.select(*[F.col(n).try_cast(t).alias(n) for n, t in names.items()])
    return typed.withColumn("announcement_timestamp", F.to_utc_timestamp(F.col("announcement_timestamp").cast("timestamp"), zone))


def write_json(value: object, path: str) -> None:
    """A small result as JSON with sorted keys."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as file:
        json.dump(value, file, indent=2, sort_keys=True, default=str)


def read_json(path: str) -> object:
    with open(path, encoding="utf-8") as file:
        return json.load(file)


def file_hash(path: str, digits: int = 16) -> str:
    """First digits of a file's SHA-256, read in blocks."""
    h = hashlib.sha256()
    with open(path, "rb") as file:
        for block in iter(lambda: file.read(1 << 20), b""):
            h.update(block)
    return h.hexdigest()[:digits]


def row_hash(df: DataFrame, columns: list[str], out: str = "row_hash") -> DataFrame:
    """Adds a SHA-256 over columns, with nulls told apart from blanks."""
    return df.withColumn(out, F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256))


PROVIDERS: dict[str, Callable[..., dict[str, DataFrame]]] = {}


def provider(name: str):
    """Registers a function that gives the named tables of a data set."""

    def keep(f):
        PROVIDERS[name] = f
        return f

    return keep


def fetch(name: str, spark: SparkSession, **options) -> dict[str, DataFrame]:
    """The tables of a registered provider."""
    if name not in PROVIDERS:
        raise ValueError(f"unknown provider {name}; known: {', '.join(sorted(PROVIDERS))}")
    return PROVIDERS[name](spark, **options)


@provider("folder")
def folder_provider(spark: SparkSession, folder: str, kind: str = "parquet") -> dict[str, DataFrame]:
    """Every table file of a folder by name."""
    names = sorted(n.removesuffix(f".{kind}") for n in os.listdir(folder) if n.endswith(f".{kind}"))
    return {n: read_table(spark, os.path.join(folder, f"{n}.{kind}"), kind) for n in names}
