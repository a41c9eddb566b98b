"""Session for tests and the benchmark."""

from __future__ import annotations

from pyspark.sql import SparkSession


# worth setting on a cluster too
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # the JVM never compiles methods above 8000 bytes; wide projections are split instead
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = 8, name: str = "sourcetrust") -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cores) if str(cores).isdigit() else "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
    )
    for setting, value in SETTINGS.items():
        builder = builder.config(setting, value)
    return builder.getOrCreate()
