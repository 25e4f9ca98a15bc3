"""Exact order statistics without sorting or collecting the column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratingml.operators.skew import running_total

# Rank error of the bracketing sketch is rows / _ACCURACY.
_ACCURACY = 10_000


def exact_rank(df: DataFrame, column: str, rank: int, total: int | None = None, small: int = 100_000):
    """The value at 1-based ``rank`` in sorted order (nulls not counted).

    Each pass brackets the rank with a mergeable quantile sketch and keeps only
    the rows inside, so the open rows shrink a few thousandfold per pass. At most
    ``small`` rows reach the driver, as counts by value. A bracket that no longer
    shrinks holds a few heavy values; they are counted and ranked by Spark.
    """
    rows = df.select(F.col(column).alias("v")).filter(F.col("v").isNotNull())
    total = rows.count() if total is None else total
    if not 1 <= rank <= total:
        raise ValueError(f"rank {rank} is outside 1..{total}")
    while total > small:
        slack = 2 * total // _ACCURACY + 1
        ends = [max(rank - slack, 1) / total, min(rank + slack, total) / total]
        low, high = rows.agg(F.percentile_approx("v", ends, _ACCURACY)).first()[0]
        below, inside = rows.agg(
            F.count_if(F.col("v") < low), F.count_if(F.col("v").between(low, high))
        ).first()
        bracketed = below < rank <= below + inside
        if bracketed and low == high:
            return low
        if not bracketed or inside == total:
            break
        rows, rank, total = rows.filter(F.col("v").between(low, high)), rank - below, inside
    counts = rows.groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    if total > small:
        ranked = running_total(counts, [F.col("v").asc()], F.col("n"), "before")
        return ranked.filter((F.col("before") < rank) & (F.lit(rank) <= F.col("before") + F.col("n"))).first()["v"]
    for value, n in sorted(counts.collect()):
        rank -= n
        if rank <= 0:
            return value
    raise AssertionError("rank not reached")


def exact_median(df: DataFrame, column: str, small: int = 100_000) -> float | None:
    """Median with the midpoint of the two middle values for an even count."""
    n = df.agg(F.count(column)).first()[0]
    if n == 0:
        return None
    upper = exact_rank(df, column, n // 2 + 1, n, small)
    lower = upper if n % 2 else exact_rank(df, column, n // 2, n, small)
    return (lower + upper) / 2
