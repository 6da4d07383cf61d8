"""A session with the settings that the operators are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "textloom", master: str | None = None, **settings: str) -> SparkSession:
    """UTC, adaptive execution with splitting of skewed joins; ``settings`` override."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    return builder.config(map=defaults | settings).getOrCreate()
