"""Session settings that the operators count on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def get_session(master: str | None = None, **more: str) -> SparkSession:
    builder = SparkSession.builder.appName("lexmill")
    if master:
        builder = builder.master(master)
    return builder.config(map=SETTINGS | more).getOrCreate()
