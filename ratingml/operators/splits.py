"""Train/test splits: at random, per user, and per user by time.

A per-user split gives a user with n counted rows the rows k with ``k/n <= f``
as train and the rest with ``k/n <= 1`` as test. A user with one row is in test
only. Rows whose counted column is null are not counted, so as many of the last
rows of the user have a ratio above 1 and are in neither part (in time order:
exactly those without a time).
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, AtomicType

from ratingml.functions import hash_order, hash_unit, named
from ratingml.operators.skew import MAX_BROADCAST_ROWS, MAX_GROUP_ROWS, hot_keys, running_total
from ratingml.storage import durable

# copies of one row are written out in runs of at most this many
_RUN = 100_000


class Split(NamedTuple):
    train: DataFrame
    test: DataFrame


def random_split(df: DataFrame, fraction: float, seed: int | None = None) -> Split:
    """Spark's own random split; repeats for one seed and one partition layout."""
    return Split(*df.randomSplit([fraction, 1.0 - fraction], seed))


def with_hash_part(df: DataFrame, fraction: float, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """Add ``part``: the side of each row, from a hash of its key; no shuffle."""
    return df.withColumn("part", F.when(hash_unit(keys, seed) < fraction, "train").otherwise("test"))


def hash_split(df: DataFrame, fraction: float, keys: Sequence[str], seed: int = 42) -> Split:
    """Random split that is the same under any partition layout."""
    return _both(with_hash_part(df, fraction, keys, seed))


def _both(df: DataFrame) -> Split:
    return Split(*[df.filter(F.col("part") == name).drop("part") for name in ("train", "test")])


def _sortable(df: DataFrame) -> list[str]:
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, AtomicType)
        or (isinstance(f.dataType, ArrayType) and isinstance(f.dataType.elementType, AtomicType))
    ]


def ranked_in_group(
    df: DataFrame,
    group: str,
    order: Sequence[Column],
    count_col: str | None = None,
    max_group_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Add ``count`` (non-null ``count_col`` in the group), ``place`` (from 1) and ``ratio``.

    Groups of up to ``max_group_rows`` rows are sorted in one task each, all in
    one shuffle. Larger groups are ranked over the whole cluster: copies of a row
    are first merged into one row with a weight, the distinct rows are sorted
    across partitions, and running weights give the places.
    """
    counted = F.lit(1) if count_col is None else F.col(count_col)
    hot = durable(hot_keys(df, [group], max_group_rows).select(F.col(group).alias("__hot")))
    n_hot = hot.count()
    usual = df
    if n_hot:
        hot = F.broadcast(hot) if n_hot <= MAX_BROADCAST_ROWS else hot
        is_hot = F.col(group).eqNullSafe(F.col("__hot"))
        usual = df.join(hot, is_hot, "left_anti")
    # places first: their sort order serves the count as well
    window = Window.partitionBy(group)
    ranked = usual.withColumn("place", F.row_number().over(window.orderBy(*order)).cast("long"))
    ranked = ranked.withColumn("count", F.count(counted).over(window)).select(*[named(c) for c in df.columns], "count", "place")
    if n_hot:
        heavy = df.join(hot, is_hot, "left_semi")
        ranked = ranked.unionByName(_rank_heavy(heavy, group, order, counted, n_hot))
    return ranked.withColumn("ratio", F.try_divide(F.col("place").cast("double"), F.col("count").cast("double")))


def _rank_heavy(
    df: DataFrame, group: str, order: Sequence[Column], counted: Column, n_groups: int
) -> DataFrame:
    columns = [named(c) for c in df.columns]
    distinct = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("__copies"))
    totals = running_total(distinct, [F.col(group).asc(), *order], F.col("__copies"), "__before")
    groups = totals.groupBy(F.col(group).alias("__group")).agg(
        F.min("__before").alias("__first"),
        F.sum(F.when(counted.isNotNull(), F.col("__copies")).otherwise(0)).alias("count"),
    )
    groups = F.broadcast(groups) if n_groups <= MAX_BROADCAST_ROWS else groups
    placed = totals.join(groups, F.col(group).eqNullSafe(F.col("__group")))
    placed = placed.withColumn("__start", F.col("__before") - F.col("__first"))
    few = placed.filter(F.col("__copies") <= _RUN).withColumn("__run", F.lit(0).cast("long"))
    runs = F.sequence(F.lit(0).cast("long"), F.floor((F.col("__copies") - 1) / _RUN).cast("long"))
    many = placed.filter(F.col("__copies") > _RUN).withColumn("__run", F.explode(runs))
    spread = few.unionByName(many.repartition(*columns, "__run"))
    first = F.col("__start") + F.col("__run") * _RUN + 1
    last = F.col("__start") + F.least(F.col("__copies"), (F.col("__run") + 1) * _RUN)
    return spread.withColumn("place", F.explode(F.sequence(first, last))).select(*columns, "count", "place")


def with_user_part(
    df: DataFrame,
    fraction: float,
    user_col: str,
    order: Sequence[Column],
    count_col: str | None,
    max_group_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Add ``count``, ``ratio`` and ``part`` (``train``, ``test`` or null) in one pass.

    Columns of these names, as an earlier split leaves them, are replaced.
    """
    df = df.drop("count", "ratio", "part")
    # the remaining columns settle ties, so two reads of the plan agree
    sortable = _sortable(df)
    total_order = [*order, *[named(c).asc() for c in sortable if c != user_col]]
    # columns that cannot be compared count by their text
    total_order += [F.to_json(F.struct(named(c))).asc() for c in df.columns if c not in sortable]
    ranked = ranked_in_group(df, user_col, total_order, count_col, max_group_rows).drop("place")
    part = F.when(F.col("ratio") <= fraction, "train").when(F.col("ratio") <= 1.0, "test")
    return ranked.withColumn("part", part)


def stratified_parts(
    df: DataFrame,
    fraction: float,
    user_col: str = "user_id",
    count_col: str | None = "item_id",
    keys: Sequence[str] = ("item_id",),
    seed: int = 42,
    order: str = "hash",
    max_group_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Per-user random split as one table with ``count``, ``ratio`` and ``part``.

    ``order="hash"`` orders a user's rows by a seeded hash of the user and ``keys``: each
    user has an order of their own, and it repeats anywhere. ``order="rand"`` draws numbers; they are written once, so that both
    parts see the same draw.
    """
    if order == "hash":
        return with_user_part(df, fraction, user_col, [hash_order([user_col, *keys], seed)], count_col, max_group_rows)
    if order != "rand":
        raise ValueError("order must be 'hash' or 'rand'")
    drawn = durable(df.withColumn("__draw", F.rand(seed)))
    return with_user_part(drawn, fraction, user_col, [F.col("__draw")], count_col, max_group_rows).drop("__draw")


def stratified_split(df: DataFrame, fraction: float, user_col: str = "user_id", **options) -> Split:
    """Per-user random split; see ``stratified_parts`` for the options."""
    return _both(stratified_parts(df, fraction, user_col, **options))


def chronological_parts(
    df: DataFrame,
    fraction: float,
    user_col: str = "user_id",
    time_col: str = "ts",
    keys: Sequence[str] = ("item_id",),
    max_group_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Per-user split by time as one table; ties in time are ordered by ``keys``."""
    order = [F.col(time_col).asc_nulls_last(), *[F.col(k).asc() for k in keys]]
    return with_user_part(df, fraction, user_col, order, time_col, max_group_rows)


def chronological_split(df: DataFrame, fraction: float, user_col: str = "user_id", **options) -> Split:
    """Per-user split by time; see ``chronological_parts`` for the options."""
    return _both(chronological_parts(df, fraction, user_col, **options))
