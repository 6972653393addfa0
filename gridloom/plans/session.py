"""A session with the settings the engine is tested with."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def session(master: str | None = None, partitions: int | None = None, **more: str) -> SparkSession:
    """ANSI mode stays on, as Spark has it; ``master`` and ``partitions`` are left to the cluster unless given."""
    b = SparkSession.builder.appName("gridloom")
    if master:
        b = b.master(master)
    for k, v in (SETTINGS | ({"spark.sql.shuffle.partitions": str(partitions)} if partitions else {}) | more).items():
        b = b.config(k, v)
    return b.getOrCreate()
