"""A session with the settings that the plans are made for; a cluster's own settings win where they are given."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",  # partition sizes and join kinds from what was measured
    "spark.sql.adaptive.skewJoin.enabled": "true",  # hot keys of joins are split
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def build_session(name: str = "pagequarry", **settings: str) -> SparkSession:
    """``settings`` use underscores for dots: build_session(spark_sql_shuffle_partitions="2000")."""
    builder = SparkSession.builder.appName(name)
    for key, value in (SETTINGS | {k.replace("_", "."): v for k, v in settings.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
