"""Joins of ratings, items and feature tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame

from ratingml.operators.skew import join


def join_items(ratings: DataFrame, items: DataFrame, key: str = "item_id", hot_rows: int | None = None) -> DataFrame:
    """Inner join of ratings and items on their shared key."""
    return join(ratings, items, key, "inner", hot_rows)


def join_on_names(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Inner join on differently named keys; the right key is dropped."""
    return left.join(right, left[left_key] == right[right_key], "inner").drop(right_key)


def concat_features(frames: Sequence[DataFrame], key: str) -> DataFrame:
    """Put feature tables side by side.

    Rows have no positions in Spark, so every frame carries ``key``. All joins
    use that one key, so each frame is shuffled once at most.
    """
    return reduce(lambda left, right: left.join(right, key, "inner"), frames)
