"""Session settings the plans count on."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Splitting a skewed join partition is worth an extra shuffle when one key may hold a
# large part of the rows. Everything else adaptive is on by default.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def builder(app: str = "starmill") -> SparkSession.Builder:
    made = SparkSession.builder.appName(app)
    for name, value in SETTINGS.items():
        made = made.config(name, value)
    return made


def local(cpus: int | str = 8, memory: str = "12g", shuffle_partitions: int = 8) -> SparkSession:
    """Local session for tests and the benchmark."""
    return (
        builder().master(f"local[{cpus}]")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
