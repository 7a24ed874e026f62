"""A session with the settings the engine assumes."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "ledgerloom", **conf: str) -> SparkSession:
    """UTC, ANSI arithmetic (overflow raises), adaptive execution. Cluster sizing is left to the caller."""
    builder = SparkSession.builder.appName(app)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.parquet.filterPushdown": "true",
    }
    for key, value in {**settings, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
