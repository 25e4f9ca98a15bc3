"""Input schemas of the two source tables and of a score request."""

from pyspark.sql.types import (
    DoubleType,
    IntegerType,
    StringType,
    StructField,
    StructType,
)

#: Value of ``rating`` that means "seen but not rated".
UNRATED = -1

RATINGS = StructType(
    [
        StructField("user_id", IntegerType()),
        StructField("item_id", IntegerType()),
        StructField("rating", IntegerType()),
    ]
)

#: ``episodes`` may hold the text "Unknown"; the reader turns it into null.
ITEMS = StructType(
    [
        StructField("item_id", IntegerType()),
        StructField("name", StringType()),
        StructField("genre", StringType()),
        StructField("type", StringType()),
        StructField("episodes", IntegerType()),
        StructField("rating", DoubleType()),
        StructField("members", IntegerType()),
    ]
)

REQUESTS = StructType(
    [
        StructField("name", StringType()),
        StructField("type", StringType()),
        StructField("episodes", IntegerType()),
        StructField("web_rating", DoubleType()),
        StructField("members", IntegerType()),
    ]
)
