"""The session that the library expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "declara", **conf: str) -> SparkSession:
    """UTC, adaptive execution, Arrow. Everything else is left to the cluster's settings."""
    builder = SparkSession.builder.appName(app)
    fixed = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    for key, value in (fixed | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
