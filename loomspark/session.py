"""SparkSession factory."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "loomspark", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; settings of a cluster come from outside and win."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
