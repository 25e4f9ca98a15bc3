"""Filters, projections and null handling."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from ratingml.functions import hash_unit, number_or_null, rating_label
from ratingml.operators.quantiles import exact_median
from ratingml.schemas import UNRATED

#: Text that stands for a missing category.
MISSING = "Missing"


def drop_unrated(df: DataFrame, rating: str = "rating") -> DataFrame:
    """Rows with a real rating; a null rating is dropped too."""
    return df.filter(F.col(rating) != UNRATED)


def complete_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows in which every (given) column has a value."""
    present = [F.col(f"`{c}`").isNotNull() for c in columns or df.columns]
    return df.filter(reduce(Column.__and__, present))


def equal_to(df: DataFrame, column: str, value: object) -> DataFrame:
    return df.filter(F.col(column) == F.lit(value))


def sample_rows(df: DataFrame, fraction: float, seed: int | None = None) -> DataFrame:
    """Bernoulli sample; repeats for one seed and one partition layout."""
    return df.sample(withReplacement=False, fraction=fraction, seed=seed)


def sample_by_hash(df: DataFrame, fraction: float, keys: Sequence[str], seed: int = 222) -> DataFrame:
    """Sample fixed by key and seed, the same under any partition layout."""
    return df.filter(hash_unit(keys, seed) < fraction)


def rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(names))


def drop_columns(df: DataFrame, *names: str) -> DataFrame:
    """Without the named columns; unknown names are ignored."""
    return df.drop(*names)


def cast_columns(df: DataFrame, kinds: Mapping[str, str]) -> DataFrame:
    """Cast in place; text that does not parse becomes null."""
    return df.withColumns({c: number_or_null(c, kind) for c, kind in kinds.items()})


def add_label(df: DataFrame, rating: str = "rating", label: str = "label") -> DataFrame:
    return df.withColumn(label, rating_label(rating))


def fill_constant(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    return df.fillna(dict(values))


def null_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row ``(column, nulls)`` for each column, from one pass over the data."""
    names = list(columns or df.columns)
    counted = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in names])
    return counted.unpivot([], [F.col(f"`{c}`") for c in names], "column", "nulls")


def impute(
    df: DataFrame,
    mean_cols: Sequence[str] = (),
    median_cols: Sequence[str] = (),
    constants: Mapping[str, object] | None = None,
    reference_frame: DataFrame | None = None,
    relative_error: float = 0.1,
    exact: bool = False,
) -> DataFrame:
    """Fill nulls with constants, column means and column medians.

    Means of integer columns are truncated. Means and medians come from
    ``reference_frame`` (default: ``df`` itself, which weights an item by its
    ratings; give the items table to weight each item once) in one aggregation.
    A median is an approximate one of ``relative_error`` in rank, or the exact
    midpoint with ``exact=True``.
    """
    source = df if reference_frame is None else reference_frame
    fills = dict(constants or {})
    accuracy = max(1, int(round(1 / relative_error)))
    wanted = [F.avg(c).alias(c) for c in mean_cols]
    if not exact:
        wanted += [F.percentile_approx(c, 0.5, accuracy).alias(c) for c in median_cols]
    if wanted:
        fills.update(source.agg(*wanted).first().asDict())
    if exact:
        fills.update({c: exact_median(source, c) for c in median_cols})
    # a column without any value has no mean or median, and stays null
    return df.fillna({c: v for c, v in fills.items() if v is not None})


def sentinel_to_number(
    df: DataFrame,
    column: str,
    sentinel: str = "Unknown",
    value: int | None = 0,
    whole_row: bool = False,
    keep: Sequence[str] = (),
    output: str | None = None,
) -> DataFrame:
    """Turn a text column into an int one; ``sentinel`` becomes ``value``.

    ``value=None`` leaves null. ``whole_row=True`` sets the other numbers and texts
    of a sentinel row to ``value`` as well, as a masked assignment in pandas does,
    but for the columns in ``keep``.
    """
    out = output or column
    hit = F.col(column) == sentinel
    number = F.when(hit, F.lit(value).cast("int")).otherwise(number_or_null(column))
    if not whole_row:
        return df.withColumn(out, number)
    zeroed = {
        f.name: F.when(hit, F.lit(value).cast(f.dataType)).otherwise(F.col(f.name))
        for f in df.schema.fields
        if f.name not in (column, *keep) and isinstance(f.dataType, (NumericType, StringType))
    }
    return df.withColumns({**zeroed, out: number})


def process(
    df: DataFrame,
    filter_na: bool = False,
    convert_label: bool = True,
    reference_frame: DataFrame | None = None,
) -> DataFrame:
    """Complete rows only, or imputed ones; then the class label if asked."""
    if filter_na:
        cleaned = complete_rows(df)
    else:
        cleaned = impute(
            df,
            mean_cols=["episodes"],
            median_cols=["web_rating"],
            constants={"genre": MISSING, "type": MISSING},
            reference_frame=reference_frame,
        )
    return add_label(cleaned) if convert_label else cleaned
