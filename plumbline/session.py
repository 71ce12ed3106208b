"""A SparkSession with the settings this library is tested under."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "plumbline", cores: str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """Local session for tests and the bench; on a cluster the submitter configures Spark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
