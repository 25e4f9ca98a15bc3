"""Tables and folders that survive the loss of an executor."""

from __future__ import annotations

import math
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows of a part that a learner keeps as vectors. A task away from its part fetches it whole, beside the kept parts.
KEPT_ROWS = 100_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.

    On a cluster it must be set. Only a local master may fall back to a temporary
    folder, which the session then remembers.
    """
    context = spark.sparkContext
    known = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if known is None:
        # local-cluster has executors of its own, so it counts as a cluster
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="ratingml-"))
        known = context.getCheckpointDir()
    return known


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and go on from there.

    What reads the result twice sees the same rows, also after a lost executor.
    Unlike a checkpoint the table is columnar: readers take only the columns they
    need, and the optimizer knows its size.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "step")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, rows: int = 500_000) -> DataFrame:
    """``durable``, dealt over so many tasks that each holds about ``rows`` rows at most.

    For learners that keep rows in a wider form than a shuffle does: merged partitions, small
    as they are when they are read, would become large blocks there.
    """
    return dealt(durable(df), rows)


def dealt(stored: DataFrame, rows: int = 500_000) -> DataFrame:
    """The same for a table that is stored already: one more count of it, and no shuffle while it is small."""
    parts = math.ceil(stored.count() / rows)
    return stored.repartition(parts) if parts > stored.sparkSession.sparkContext.defaultParallelism else stored


def keyed(df: DataFrame, rows: int, *keys: str, most: int = 500_000) -> DataFrame:
    """``df``, of about ``rows`` rows, over so many tasks by its keys that each holds about ``most`` rows.

    For a join or grouping by ``keys`` whose tasks would grow with the table, as the session's number of shuffle
    partitions is fixed. Unchanged while that number is enough.
    """
    parts = math.ceil(rows / most)
    enough = parts <= int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df if enough else df.repartition(parts, *keys)


def run_dir(spark: SparkSession) -> str:
    """The folder of this application below the shared one; all stored tables and files are in it."""
    return f"{shared_dir(spark).rstrip('/')}/ratingml-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder of this application."""
    return f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"


def remove_run(spark: SparkSession) -> bool:
    """Delete all that this application stored; tells whether there was anything.

    For the end of an application: DataFrames that were not written elsewhere can no longer be read.
    """
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    folder = hadoop.Path(run_dir(spark))
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
