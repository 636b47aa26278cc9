"""The Spark session that queries, tests and the bench share."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def get_spark(master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A UTC session with adaptive execution; on a cluster the submitted settings win."""
    builder = SparkSession.builder.appName("ledgerlake").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false").config("spark.driver.memory", os.environ.get("LEDGERLAKE_DRIVER_MEMORY", "8g"))
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions or 8))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
