"""The session the queries expect: UTC, adaptive execution, quiet."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_session(master: str = "local[8]", shuffle_partitions: int = 8, driver_memory: str = "8g") -> SparkSession:
    spark = (
        SparkSession.builder.master(master)
        .appName("recallgrid")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", driver_memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
