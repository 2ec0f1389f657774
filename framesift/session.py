"""Session settings that the engine's results rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build(app: str = "framesift", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; other settings come from the cluster."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for k, v in conf.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
