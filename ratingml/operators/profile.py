"""Counts and value lists that describe a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratingml.functions import multi_values

#: Most values a vocabulary may have before it is taken for a mistake.
MAX_VALUES = 10_000


def profile(df: DataFrame, user: str = "user_id", item: str = "item_id", approximate: bool = False) -> DataFrame:
    """One row: number of rows, users and items, in one aggregation."""
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"), distinct(user).alias("n_users"), distinct(item).alias("n_items")
    )


def shape(df: DataFrame) -> DataFrame:
    """One row ``(n_rows, n_columns)``."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.lit(len(df.columns)).alias("n_columns"))


def mean(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.avg(column).alias(f"mean_{column}"))


def distinct_values(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns).distinct()


def value_table(df: DataFrame, column: str, sep: str = ",") -> DataFrame:
    """Distinct values of a multi-valued text column as rows; nulls and empties left out."""
    values = df.select(F.explode(multi_values(column, sep)).alias("value"))
    return values.filter(F.col("value") != "").distinct()


def bounded_list(values: DataFrame, max_values: int = MAX_VALUES) -> list:
    """The first column of ``values``, sorted, on the driver; an error above the bound."""
    name = values.columns[0]
    # the limit reads one row more than allowed, only to notice the excess
    found = [row[0] for row in values.select(name).limit(max_values + 1).collect()]
    if len(found) > max_values:
        raise ValueError(f"column {name} has more than {max_values} distinct values")
    return sorted(found)


def vocabulary(df: DataFrame, column: str, sep: str = ",", max_values: int = MAX_VALUES) -> list[str]:
    """Sorted vocabulary of a multi-valued text column."""
    return bounded_list(value_table(df, column, sep), max_values)


def categories(df: DataFrame, column: str, max_values: int = MAX_VALUES) -> list:
    """Sorted distinct values of a column, nulls left out."""
    return bounded_list(distinct_values(df, column).filter(F.col(column).isNotNull()), max_values)


def first_rows(df: DataFrame, n: int, order: Sequence) -> DataFrame:
    """The first ``n`` rows in a given order."""
    return df.orderBy(*order).limit(n)


def value_counts(df: DataFrame, *columns: str) -> DataFrame:
    """Rows per value (or value combination)."""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
