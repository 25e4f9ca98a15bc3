"""Scoring of rows as they arrive."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ratingml.operators.scoring import input_fields, null_reason, require_fields


def read_requests(
    spark: SparkSession, path: str, schema: StructType, file_format: str = "parquet", files_per_batch: int | None = None
) -> DataFrame:
    """Stream of request files as they land in ``path``."""
    reader = spark.readStream.schema(schema).format(file_format)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def scored_stream(model: PipelineModel, requests: DataFrame, output: Sequence | None = None) -> DataFrame:
    """Stateless scoring; rows with a null input are left out."""
    require_fields(model, requests.schema)
    complete = requests.filter(null_reason(input_fields(model)).isNull())
    scored = model.transform(complete)
    return scored.select(*output) if output else scored


def rejected_stream(model: PipelineModel, requests: DataFrame) -> DataFrame:
    """The rows that ``scored_stream`` leaves out, with the reason."""
    require_fields(model, requests.schema)
    marked = requests.withColumn("reason", null_reason(input_fields(model)))
    return marked.filter(F.col("reason").isNotNull())


def start_scoring(
    scored: DataFrame, path: str, checkpoint: str, available_now: bool = False, interval: str = "10 seconds"
) -> StreamingQuery:
    """Append scored rows to Parquet files, exactly once per input row."""
    writer = scored.writeStream.format("parquet").outputMode("append")
    writer = writer.option("path", path).option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if available_now else {"processingTime": interval}
    return writer.trigger(**trigger).start()
