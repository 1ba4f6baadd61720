"""Session settings shared by tests, bench and ad-hoc use; a cluster brings its own session."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(cpus: int | str = 8, app: str = "foliant", **conf: str) -> SparkSession:
    """A local session in UTC with adaptive execution; `conf` entries (dots as `__`) override."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session
