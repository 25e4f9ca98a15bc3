"""URL verdicts from host and path rules and from a block list in a Bloom filter cascade.

The cascade answers "is this key listed?" exactly for every key of a known
universe (here: every host of the table and all its parent domains). Level 0 is a
Bloom filter of the listed keys; level 1 holds the unlisted keys of the universe
that pass level 0; level 2 the listed keys that pass level 1; and so on until a
level has no false positive. A key is listed if the first level that rejects it is
odd. The levels are bytes in the expression, so no join is needed.

Size: level 0 has about ``1.44 * n * log2(U / n)`` bits for n listed keys in a
universe of U, and all further levels together a few bits per listed key. The bound
grows with the list, not with the table (but for the logarithm), and ``build``
stops with an error above ``max_bytes``.

Defined results: a null url, or one without ``://``, has an empty host and an empty
path, and an empty host is never listed. Repeated rows get the same verdict each.
Other columns of the input are not read and may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratingml.llm.common import ascii_lower, stored

#: Fixed rules of the query: verdict and host/path.
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)

#: Registered names whose hosts the production list blocks.
LISTED_NAMES = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
LISTED_ZONES = ("example.com", "example.net", "example.org")
LISTED = tuple(f"{name}.{zone}" for name in LISTED_NAMES for zone in LISTED_ZONES)

MAX_BYTES = 16 << 20


class Level(NamedTuple):
    """A Bloom filter: its bits, their number, the number of hashes and a salt."""

    bits: bytes
    size: int
    hashes: int
    salt: int


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def domains_of(host: Column) -> Column:
    """The host and all its parent domains."""
    labels = F.split(host, r"\.")
    return F.when(host == "", F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    )


def rule_columns(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, both null if none fits.

    Rules of equal length are tried in the order of their text.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for decision, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        rule_host, _, rest = text.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith("/" + rest)
        rule = F.when(fits, text).otherwise(rule)
        verdict = F.when(fits, decision).otherwise(verdict)
    return rule, verdict


def _places(key: Column, size: int, hashes: int, salt: int) -> list[Column]:
    """Bit places of a key: two hashes give them all."""
    first, second = (F.pmod(F.xxhash64(key, F.lit(2 * salt + i)), F.lit(1 << 40)) for i in (0, 1))
    return [F.pmod(first + second * F.lit(i), F.lit(size)) for i in range(hashes)]


def passes(key: Column, level: Level) -> Column:
    """Whether every bit of the key is set."""
    bits, found = F.lit(bytearray(level.bits)), F.lit(True)
    for place in _places(key, level.size, level.hashes, level.salt):
        one = F.substring(bits, (F.floor(place / 8) + 1).cast("int"), F.lit(1))
        byte = F.conv(F.hex(one), 16, 10).cast("int")
        found = found & (F.floor(byte / F.pow(F.lit(2), place % 8)).cast("int") % 2 == 1)
    return found


def _level(keys: DataFrame, n: int, rate: float, salt: int, max_bytes: int) -> Level:
    """Set the bits of all keys; Spark puts the bytes together in order."""
    hashes = max(1, round(math.log2(1 / rate)))
    size = 8 * math.ceil(max(64, hashes * n / math.log(2)) / 8)
    if size // 8 > max_bytes:
        raise ValueError(f"a level of the cascade needs {size // 8} bytes; max_bytes is {max_bytes}")
    spark = keys.sparkSession
    places = keys.select(F.explode(F.array(*_places(F.col("key"), size, hashes, salt))).alias("place"))
    byte = places.select(F.floor(F.col("place") / 8).alias("at"), F.pow(F.lit(2), F.col("place") % 8).cast("int").alias("bit"))
    set_bytes = byte.groupBy("at").agg(F.bit_or("bit").alias("byte"))
    whole = spark.range(size // 8).withColumnRenamed("id", "at").join(set_bytes, "at", "left")
    parts = whole.select("at", F.lpad(F.hex(F.coalesce("byte", F.lit(0))), 2, "0").alias("two"))
    row = parts.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "two"))), lambda x: x["two"]), "").alias("hex"))
    return Level(bytes.fromhex(row.first()["hex"]), size, hashes, salt)


def build(universe: DataFrame, listed: DataFrame, max_bytes: int = MAX_BYTES) -> list[Level]:
    """The levels for ``listed`` over ``universe``; both have one text column ``key``.

    Listed keys outside the universe stay out of the filter. Null keys are ignored.
    No listed key at all gives no level: nothing is listed then.
    """
    keys = universe.filter("key IS NOT NULL").distinct()
    marks = listed.filter("key IS NOT NULL").distinct().withColumn("listed", F.lit(True))
    keys = stored(keys.join(marks, "key", "left").select("key", F.col("listed").isNotNull().alias("listed")), "url-keys")
    counts = keys.agg(F.count_if("listed").alias("n"), F.count(F.lit(1)).alias("all")).first()
    held, others, n = keys.filter("listed"), keys.filter("NOT listed"), counts["n"]
    levels: list[Level] = []
    while n:
        # the first level thins out the universe, later ones halve what is left
        rate = 0.5 if levels else min(0.5, n / (math.sqrt(2) * max(1, counts["all"] - n)))
        level = _level(held, n, rate, len(levels), max_bytes)
        levels.append(level)
        wrong = stored(others.filter(passes(F.col("key"), level)), "url-level")
        held, others, n = wrong, held, wrong.count()
    return levels


def is_listed(key: Column, levels: Sequence[Level]) -> Column:
    """Exact for keys of the universe: the last level that is passed, each one before it too, is even."""
    found = F.lit(False)
    for number in range(len(levels) - 1, -1, -1):
        found = F.when(passes(key, levels[number]), found if number < len(levels) - 1 else F.lit(number % 2 == 0)).otherwise(
            F.lit(number % 2 == 1)
        )
    return found


def verdicts(
    pages: DataFrame,
    listed: DataFrame,
    rules: Sequence[tuple[str, str]] = RULES,
    id_col: str = "page_id",
    url_col: str = "url",
    max_bytes: int = MAX_BYTES,
) -> DataFrame:
    """``id, host, path, rule, verdict`` for every row: the rule's verdict, else block if the host
    or one of its parent domains is listed."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    rows = rows.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    hosts = rows.select("host").distinct()
    universe = hosts.select(F.explode(domains_of(F.col("host"))).alias("key"))
    levels = build(universe, listed, max_bytes)
    rule, decision = rule_columns(F.col("host"), F.col("path"), rules)
    blocked = F.exists(domains_of(F.col("host")), lambda d: is_listed(d, levels))
    found = F.coalesce(decision, F.when(blocked, "block").otherwise("allow"))
    return rows.select(F.col("page_id").alias(id_col), "host", "path", rule.alias("rule"), found.alias("verdict"))
