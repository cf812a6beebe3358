"""The Spark session that the engine expects."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Settings that results or plans depend on; a cluster's own settings win over the rest.
REQUIRED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(name: str = "lodestone", **settings: str) -> SparkSession:
    """A session with the required settings and any given ones, dots as double underscores."""
    builder = SparkSession.builder.appName(name)
    for key, value in (REQUIRED | {k.replace("__", "."): v for k, v in settings.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
