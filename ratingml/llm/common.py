"""Small helpers that several operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ratingml.storage import scratch_path

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share."""
    return scratch_path(spark, name)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: later readers see the same rows."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def kept_apart(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that later expressions read as stored values.

    A lambda that names a computed column would compute it again for each element
    once the optimizer merges both projections; a generator between them stops that.
    """
    names = list(columns)
    packed = F.explode(F.array(F.struct(*[columns[n].alias(n) for n in names])))
    others = [c for c in df.columns if c not in names]
    out = df.select("*", packed.alias("__packed"))
    return out.select(*[quoted(c) for c in others], *[F.col(f"__packed.{n}").alias(n) for n in names])


def quoted(name: str) -> Column:
    """A column by its exact name, also with dots or backticks in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case; all other characters stay."""
    return F.translate(text, UPPER, UPPER.lower())
