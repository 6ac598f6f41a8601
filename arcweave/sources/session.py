"""Session settings that the engine relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(
    name: str = "arcweave",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    driver_memory: str | None = None,
) -> SparkSession:
    """A session with UTC times, adaptive execution and skew handling on.

    ``master`` and ``driver_memory`` are for local runs; on a cluster leave them unset so
    that the submitter's values hold.
    """
    builder = (
        SparkSession.builder.appName(name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false").config("spark.driver.host", "127.0.0.1")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if driver_memory:
        builder = builder.config("spark.driver.memory", driver_memory)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session
