"""A session with the settings the package is tuned for.

Every function of the package takes its session from the DataFrames it is
given, so a caller's own session works as well.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Settings that matter for the plans built here, on a cluster or locally.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a skewed join side even where that costs one more exchange
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.files.maxPartitionBytes": "128m",
}


def build_session(
    master: str | None = None, app_name: str = "ratingml", input_bytes: int | None = None, **extra: str
) -> SparkSession:
    """Get or create a session; ``extra`` keys use ``__`` in place of dots.

    ``input_bytes`` sets the number of partitions that a shuffle starts with, 128 MB each;
    adaptive execution merges small ones.
    """
    if input_bytes:
        extra["spark__sql__adaptive__coalescePartitions__initialPartitionNum"] = str(max(200, input_bytes >> 27))
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **{k.replace("__", "."): v for k, v in extra.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
