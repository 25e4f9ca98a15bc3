"""Steps that stay balanced when one key holds a large part of the rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratingml.storage import durable

#: Most rows of one key that a single task should hold.
MAX_GROUP_ROWS = 5_000_000
#: Most rows, and most bytes as text, that a side may have to be broadcast by a hint.
MAX_BROADCAST_ROWS = 500_000
MAX_BROADCAST_BYTES = 256 << 20
# numbers that rows without an open key are spread over
_SPREAD = 1 << 20
# monotonically_increasing_id puts the partition number above this many bits
_PLACE_BITS = 33


def hot_keys(df: DataFrame, keys: Sequence[str], above: int = MAX_GROUP_ROWS) -> DataFrame:
    """Keys with more than ``above`` rows; at most rows / ``above`` of them exist."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows")).filter(F.col("__rows") > above)


def join(
    left: DataFrame,
    right: DataFrame,
    on: str | Sequence[str],
    how: str = "inner",
    hot_rows: int | None = None,
    known_hot: DataFrame | None = None,
) -> DataFrame:
    """Equi-join that keeps one copy of each key column.

    The optimizer broadcasts a side whose size is below its threshold, and
    adaptive execution splits skewed partitions of a sorted join. With
    ``hot_rows`` the keys of ``left`` above that many rows are answered apart, see
    ``_join_hot``. A caller that has counted the keys gives the hot ones as
    ``known_hot``.
    """
    keys = [on] if isinstance(on, str) else list(on)
    if hot_rows is None and known_hot is None:
        return left.join(right, keys, how)
    if how not in ("inner", "left"):
        raise ValueError("hot keys can be set apart in inner and left joins only")
    hot = known_hot
    if hot is None:
        hot = hot_keys(left.dropna(subset=keys), keys, hot_rows).select(*keys)
    hot = durable(hot)
    n_hot = hot.count()
    if n_hot == 0 or n_hot > MAX_BROADCAST_ROWS:
        return left.join(right, keys, how)
    matching = right.join(F.broadcast(hot), keys, "left_semi")
    size = matching.agg(F.count(F.lit(1)), F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()
    if size[0] > MAX_BROADCAST_ROWS or (size[1] or 0) > MAX_BROADCAST_BYTES:
        return left.join(right, keys, how)
    return _join_hot(left, right, keys, how, hot, matching)


def _join_hot(
    left: DataFrame, right: DataFrame, keys: list[str], how: str, hot: DataFrame, matching: DataFrame
) -> DataFrame:
    """Answer hot keys from a broadcast and the others by a usual join, in one pass over ``left``.

    Rows with a hot or a null key take no key into the usual join, only a number
    that spreads them, so they match nothing there and fill no single partition.
    """
    names = [c for c in right.columns if c not in keys]
    found = F.struct(F.lit(True).alias("__found"), *names)
    answers = hot.join(matching.select(*keys, found.alias("__row")), keys, "left")
    answers = answers.select(*keys, F.struct("__row").alias("__hot"))
    if how == "inner":
        left = left.dropna(subset=keys)
    tagged = left.join(F.broadcast(answers), keys, "left")
    settled = F.col("__hot").isNotNull()
    no_key = reduce(Column.__or__, [F.col(k).isNull() for k in keys], settled)
    spread = F.pmod(F.xxhash64(*[F.col(c) for c in left.columns]), F.lit(_SPREAD))
    tagged = tagged.withColumn("__spread", F.when(no_key, spread).otherwise(F.lit(0)))
    open_keys = [f"__open_{k}" for k in keys]
    for k, name in zip(keys, open_keys):
        tagged = tagged.withColumn(name, F.when(~settled, F.col(k)))
    others = right.join(F.broadcast(hot), keys, "left_anti")
    others = others.select(
        *[F.col(k).alias(name) for k, name in zip(keys, open_keys)],
        F.lit(0).cast("long").alias("__spread"),
        found.alias("__cold"),
    )
    joined = tagged.join(others, [*open_keys, "__spread"], "left")
    row = F.coalesce("__hot.__row", "__cold")
    joined = joined.withColumn("__row", row)
    if how == "inner":
        joined = joined.filter(F.col("__row.__found"))
    rest = [F.col(c) for c in left.columns if c not in keys]
    return joined.select(*keys, *rest, *[F.col("__row").getField(c).alias(c) for c in names])


def running_total(df: DataFrame, order: Sequence[Column], weight: Column | None, name: str) -> DataFrame:
    """Sum of ``weight`` over all rows before each row in a total order.

    The rows are range-partitioned and sorted, so a large group is spread over
    many tasks. The sorted rows are written once with their place, because the
    range bounds come from a sample and must not be drawn again. Only one total
    per sort partition reaches the driver. ``weight=None`` counts rows and needs
    no further shuffle.
    """
    placed = df.orderBy(*order).withColumn("__place", F.monotonically_increasing_id())
    if weight is not None:
        placed = placed.withColumn("__weight", weight.cast("long"))
    placed = durable(placed).withColumn("__part", F.shiftright("__place", _PLACE_BITS))
    size = F.count(F.lit(1)) if weight is None else F.sum("__weight")
    sizes = dict(placed.groupBy("__part").agg(size).collect())
    starts, total = [], 0
    for part in range(max(sizes, default=0) + 1):
        starts.append(total)
        total += sizes.get(part, 0)
    # one constant array, so that no join is needed and the table keeps its known size
    known = F.split(F.lit(",".join(map(str, starts))), ",").cast("array<long>")
    start = F.element_at(known, F.col("__part").cast("int") + 1)
    if weight is None:
        inside = F.col("__place").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    else:
        earlier = Window.partitionBy("__part").orderBy("__place").rowsBetween(Window.unboundedPreceding, -1)
        inside = F.coalesce(F.sum("__weight").over(earlier), F.lit(0))
    return placed.withColumn(name, start + inside).drop("__part", "__place", "__weight")


def number_rows(df: DataFrame, order: Sequence[Column], name: str = "position") -> DataFrame:
    """0-based position of each row in a total order, without one task seeing all rows."""
    return running_total(df, order, None, name)
