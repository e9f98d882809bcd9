"""Spark session settings the engine is designed around.

None of the operators needs these to be right; they are what the plans were
looked at with, and what a large cluster should start from.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    # Event timestamps are epoch milliseconds; zone-less inputs are read as UTC.
    "spark.sql.session.timeZone": "UTC",
    # Run-time partition sizing, run-time broadcast choice and skew splitting.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(
    app_name: str = "sensorloom",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Create (or reuse) a session with :data:`SETTINGS` applied."""
    builder = SparkSession.builder.appName(app_name)
    if master is not None:
        builder = builder.master(master)
    settings = dict(SETTINGS)
    if shuffle_partitions is not None:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update(extra or {})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
