"""Session builder with the settings this library is tuned for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(
    app_name: str = "cohorta",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    **settings: str,
) -> SparkSession:
    """Create (or get) a session.

    On a cluster leave ``master`` unset (spark-submit supplies it) and size
    ``shuffle_partitions`` so that one partition is some 128-256 MB of shuffle
    data; adaptive execution merges the small ones and splits skewed joins.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master is not None:
        builder = builder.master(master)
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
