"""Session settings every tidemark plan relies on."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def build_session(app: str = "tidemark", cores: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings used in tests and benchmarks (UTC, ANSI, AQE)."""
    settings = {
        "spark.master": f"local[{cores}]",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": str(cores),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": os.environ.get("TIDEMARK_DRIVER_MEMORY", "8g"),
    } | {k.replace("__", "."): v for k, v in conf.items()}
    spark = SparkSession.builder.appName(app).config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    """Sets the session zone to UTC and the checkpoint folder: the one in spark.checkpoint.dir where the session has it.

    Only a session on one machine (a test) gets a folder of its own; on a cluster without that setting none is set,
    and what needs one fails (``shared_folder``).
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and context.master.startswith("local") and not context.master.startswith("local-cluster"):
            folder = tempfile.mkdtemp(prefix="tidemark-ckpt-")
        if folder:
            context.setCheckpointDir(folder)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints and written tables that all executors see; raises where the session has none."""
    folder = spark.sparkContext.getCheckpointDir()
    if folder is None:
        raise ValueError("no shared folder: set spark.checkpoint.dir to one that every executor can reach")
    return folder
