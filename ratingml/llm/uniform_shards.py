"""Sharding: a uniform shuffle into shards of exact size through a hypergeometric matrix.

A uniform shuffle sends, from each input partition, a random number of rows to each
shard; the numbers form a matrix with fixed row sums (rows of a partition) and column
sums (rows of a shard), and follow the multivariate hypergeometric law. So:

1. each partition puts its rows into random order and is written once (a lost executor
   changes nothing after that);
2. the matrix is drawn exactly. No task and no driver holds it whole: partitions are the
   leaves of a binary tree, a node draws what its left half sends to each shard, and a
   task draws only the nodes above its own partition, each from a seed of its own;
3. the first rows of a partition go to the first shard, the next ones to the second, ...;
4. the rows are exchanged, and each shard is put into random order again.

Shards are sorted in blocks of bounded expected size, so that a shard of any size needs no task of
its own. Any permutation of the rows is equally likely, up to the quality of the
generator. One law holds, ``rows``: shard sizes differ by one row at most. Rows with
equal texts are rows like any others; a uniform shuffle keeps no group together.

Defined cases: null or repeated ids, null, empty and long texts and repeated rows are
rows like any others and all stay; an empty table gives an empty table; extra columns
come back as they are, whatever their names, also the names that this operator adds
(``shard`` and ``slot`` replace columns of those names). The result depends on the seed and on how the input
is dealt to partitions.
"""

from __future__ import annotations

from math import ceil, exp, floor, lgamma, log

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratingml.llm.common import quoted, stored

#: Rows that one block of a shard holds on average when a shard is put into its last order.
BLOCK_ROWS = 20_000
#: Up to this population numpy's own sampler is exact.
NUMPY_LIMIT = 1_000_000_000


def shard_sizes(rows: int, shards: int) -> np.ndarray:
    """Rows of each shard; the first ones have one more where they cannot be equal."""
    sizes = np.full(shards, rows // shards, np.int64)
    sizes[: rows % shards] += 1
    return sizes


def hypergeometric(rng: np.random.Generator, good: int, bad: int, taken: int) -> int:
    """How many of ``taken`` rows, drawn without replacement, are among the ``good`` ones.

    Beyond numpy's range the draw is rejection under a flat middle with exponential tails,
    which covers any log-concave law once the height of its mode is known (Devroye, 1987).
    """
    good, bad, taken = int(good), int(bad), int(taken)
    if good + bad <= NUMPY_LIMIT:
        return int(rng.hypergeometric(good, bad, taken))

    def choose(n: int, k: int) -> float:
        return lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)

    low, high = max(0, taken - bad), min(good, taken)
    mode = min(high, max(low, ((taken + 1) * (good + 1)) // (good + bad + 2)))
    top = choose(good, mode) + choose(bad, taken - mode)
    height = exp(min(0.0, top - choose(good + bad, taken)))
    flat = 1 + height / 2
    while True:
        if rng.random() <= flat / (1 + flat):
            away = rng.random() * flat / height
        else:
            away = (flat + rng.exponential()) / height
        k = mode + (1 if rng.random() < 0.5 else -1) * floor(away + 0.5)
        if low <= k <= high:
            cover = log(max(rng.random(), 1e-300)) + min(0.0, flat - height * away)
            if cover <= choose(good, k) + choose(bad, taken - k) - top:
                return k


def split(rng: np.random.Generator, sizes: np.ndarray, taken: int) -> np.ndarray:
    """A multivariate hypergeometric draw: what ``taken`` rows send to shards of ``sizes`` places."""
    out = np.zeros(len(sizes), np.int64)
    rest, left = int(sizes.sum()), int(taken)
    for i, size in enumerate(sizes):
        rest -= int(size)
        out[i] = hypergeometric(rng, int(size), rest, left) if left else 0
        left -= int(out[i])
    return out


def matrix_row(ends: np.ndarray, sizes: np.ndarray, part: int, seed: int) -> np.ndarray:
    """Row ``part`` of the matrix: rows that partition ``part`` sends to each shard.

    ``ends`` are running sums of the rows of all partitions. All calls with one seed
    draw from one matrix, whoever makes them.
    """
    begin, end = 0, len(ends)
    sizes = np.asarray(sizes, np.int64)
    while end - begin > 1:
        middle = (begin + end) // 2
        taken = int(ends[middle - 1]) - (int(ends[begin - 1]) if begin else 0)
        left = split(np.random.default_rng([seed, begin, end]), sizes, taken)
        if part < middle:
            end, sizes = middle, left
        else:
            begin, sizes = middle, sizes - left
    return sizes


def sharded(docs: DataFrame, shards: int = 24, seed: int = 24, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """All columns of ``docs`` plus ``shard`` int and ``slot`` long, which counts from 0 in each shard."""
    spark = docs.sparkSession
    names = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    # positional names inside, so that no name of the caller can clash
    inner = docs.select(*[quoted(c).alias(f"c{i}") for i, c in enumerate(names)])
    placed = inner.select("*", F.spark_partition_id().alias("part"), F.rand(seed).alias("first"), F.rand(seed + 1).alias("last"))
    # the number of a row in its partition comes after the sort, so it is its place in random order
    ordered = placed.sortWithinPartitions("first").withColumn("place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    rows = stored(ordered.drop("first"), "shards")
    # one row per input partition
    counts = {r["part"]: r["n"] for r in rows.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    numbers = np.zeros(max(counts, default=-1) + 1, np.int64)
    for part, n in counts.items():
        numbers[part] = n
    total = int(numbers.sum())
    sizes = shard_sizes(total, shards)
    shared = spark.sparkContext.broadcast((np.cumsum(numbers), sizes))

    @F.pandas_udf("int")
    def shard_of(part: pd.Series, place: pd.Series) -> pd.Series:
        ends, wanted = shared.value
        out = np.zeros(len(part), np.int32)
        parts, places = part.to_numpy(), place.to_numpy()
        for p in np.unique(parts):
            own = parts == p
            upto = np.cumsum(matrix_row(ends, wanted, int(p), seed))
            out[own] = np.searchsorted(upto, places[own], side="right")
        return pd.Series(out)

    blocks = max(1, ceil(total / shards / block_rows))
    dealt = rows.withColumn("shard", shard_of("part", "place")).withColumn("block", F.floor(F.col("last") * blocks).cast("int"))
    # the same narrow columns again give the sizes of the blocks, without the rows themselves
    small = dealt.groupBy("shard", "block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = small.select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    order = Window.partitionBy("shard", "block").orderBy("last", "part", "place")
    out = dealt.withColumn("rank", F.row_number().over(order)).join(starts, ["shard", "block"])
    slot = (F.col("base") + F.col("rank") - 1).cast("long").alias("slot")
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], "shard", slot)


def write_shards(sharded_docs: DataFrame, path: str, file_rows: int = BLOCK_ROWS) -> None:
    """One folder ``shard=<n>`` per shard, files of ``file_rows`` rows in the order of their slots."""
    file = F.floor(F.col("slot") / file_rows)
    by_slot = sharded_docs.repartition("shard", file).sortWithinPartitions("shard", "slot")
    by_slot.write.partitionBy("shard").parquet(path)
