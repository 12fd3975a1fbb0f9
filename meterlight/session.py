"""SparkSession factory with the settings every query of this library assumes."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Every bucket is a UTC calendar bucket, so the session time zone must be UTC.
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def build_session(app_name: str = "meterlight", master: str | None = None, **extra: str) -> SparkSession:
    """Return a session with UTC buckets and adaptive execution; ``extra`` adds or overrides settings."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**REQUIRED_CONF, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
