"""Column functions shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column
from pyspark.sql import functions as F

# Class 2 from rating 9, class 1 from rating 6, else class 0.
LIKED_FROM = 9
NEUTRAL_FROM = 6

# 15 hex digits are the most that fit a signed long.
_HASH_DIGITS = 15


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rating_label(rating: Column | str) -> Column:
    """Class of a rating: 2, 1 or 0; a missing rating has no class."""
    r = _col(rating)
    return F.when(r >= LIKED_FROM, 2).when(r >= NEUTRAL_FROM, 1).when(r.isNotNull(), 0)


def number_or_null(text: Column | str, kind: str = "int") -> Column:
    """Cast that gives null for text such as "Unknown", also under ANSI mode."""
    return _col(text).try_cast(kind)


def compact(text: Column | str) -> Column:
    """Lower-case text without any white space."""
    return F.lower(F.regexp_replace(F.trim(_col(text)), r"\s+", ""))


def multi_values(text: Column | str, sep: str = ",") -> Column:
    """Array of the values in "A, B C, d": compacted, in order, empties kept."""
    return F.split(compact(text), "\\Q" + sep + "\\E")


def flag(values: Column | str, value: str) -> Column:
    """1 if the array holds ``value``, else 0; null for a null array."""
    return F.array_contains(_col(values), value).cast("int")


def words(text: Column | str) -> Column:
    """All Unicode word matches of the text, case kept."""
    return F.regexp_extract_all(_col(text), F.lit(r"((?U)\w+)"))


def named(name: str) -> Column:
    """The column of exactly this name, also with dots or backticks in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def hash_order(keys: Sequence[str], seed: int) -> Column:
    """60-bit number from the md5 of the key values and the seed.

    A seeded random order that any engine repeats, in 8 bytes per row.
    """
    text = F.concat_ws(":", *[named(k).cast("string") for k in keys], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, _HASH_DIGITS), 16, 10).cast("long")


def hash_unit(keys: Sequence[str], seed: int) -> Column:
    """Number in [0, 1), fixed by key values and seed, whatever the partitioning."""
    return hash_order(keys, seed).cast("double") / float(16**_HASH_DIGITS)


def element(vector: Column | str, i: int) -> Column:
    """Element ``i`` of an ML vector."""
    return vector_to_array(_col(vector))[i]


def spread(vector: Column | str, size: int, prefix: str) -> list[Column]:
    """Columns ``<prefix>1`` .. ``<prefix>size`` from an ML vector."""
    values = vector_to_array(_col(vector))
    return [values[i].alias(f"{prefix}{i + 1}") for i in range(size)]
