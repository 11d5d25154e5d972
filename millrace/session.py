"""Session set-up."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

BATCH = "spark.sql.execution.arrow"
ROOT = str(Path(__file__).resolve().parents[1])


def session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings that this library's results assume."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("millrace")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return importable(spark)


def importable(spark: SparkSession) -> SparkSession:
    """Let Python workers import this library from where the driver did, and bound their batches.

    Rows are whole texts, so the defaults of 10,000 rows and 64 MB a batch are lowered
    unless the session has values of its own. On a cluster the library is installed or sent with ``--py-files``; then the
    added path does not exist there and changes nothing.
    """
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([*paths, ROOT])
    if spark.conf.get(f"{BATCH}.maxRecordsPerBatch") == "10000":
        spark.conf.set(f"{BATCH}.maxRecordsPerBatch", "2000")
    if spark.conf.get(f"{BATCH}.maxBytesPerBatch", None) == "67108864b":
        spark.conf.set(f"{BATCH}.maxBytesPerBatch", "8m")
    return spark
