"""A session with the settings the library expects; any session works."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Adaptive execution replans joins and splits skewed partitions at run time.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def session(name: str = "lodestrata", **settings: str) -> SparkSession:
    return SparkSession.builder.appName(name).config(map=SETTINGS | settings).getOrCreate()
