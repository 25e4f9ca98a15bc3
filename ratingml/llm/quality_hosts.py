"""Quality rules per document and per host, with built-in functions only.

Each document gets word, symbol and repetition counts. Too few words or too many
repeated three-word windows fail it. The failures are summed per host; the rate of
each host is shrunk with a beta prior whose mean and strength come from the spread
of the rates over all hosts, so a host with two failed documents is not condemned
by them. Documents of hosts whose shrunk rate is above ``max_rate`` go as well.

Hosts: sums are made on the map side, so a host with a third of all rows is one
row per task in the shuffle. The measures are written once, without the text.

Defined results: a null text has no words, so it fails. A null host is a host of
its own. Repeated rows are judged each. Windows are compared by a 64-bit hash of
their words within one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratingml.llm.common import kept_apart, stored

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_RATE = 0.6

SPACES = " \t\n\x0b\x0c\r"
SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"


def _covered(places: Column) -> Column:
    """How many words the three-word windows at these sorted places cover together."""
    start = F.struct(F.lit(0).cast("long").alias("total"), F.lit(-3).alias("last"))
    return F.aggregate(
        places,
        start,
        lambda acc, p: F.struct((acc["total"] + F.least(F.lit(3), p - acc["last"])).cast("long").alias("total"), p.alias("last")),
        lambda acc: acc["total"],
    )


def measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Replace the text by ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rest = [c for c in docs.columns if c != text_col]
    without = text
    for char in SPACES:
        without = F.replace(without, F.lit(char), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    rows = kept_apart(
        docs,
        __words=F.filter(F.split(text, SPACE + "+"), lambda w: w != ""),
        __lines=lines,
        word_chars=F.length(without).cast("long"),
        n_symbols=(F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long"),
    ).drop(text_col)
    n_windows = F.size("__words") - 2
    word = lambda i: F.get("__words", i)
    hashes = F.when(
        n_windows > 0,
        F.transform(F.sequence(F.lit(0), n_windows - 1), lambda i: F.xxhash64(word(i), word(i + 1), word(i + 2))),
    ).otherwise(F.array().cast("array<bigint>"))
    rows = kept_apart(
        rows,
        n_words=F.size("__words").cast("long"),
        n_dup_lines=(F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        __hashes=hashes,
    ).drop("__words", "__lines")
    # only texts with a repeated window need their windows sorted
    repeats = F.size(F.array_distinct("__hashes")) < F.size("__hashes")
    in_order = F.when(repeats, F.sort_array(F.transform("__hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    rows = kept_apart(rows, __sorted=in_order).drop("__hashes")
    near = lambda i: F.get("__sorted", i)["h"]
    twice = F.filter("__sorted", lambda x, i: ((i > 0) & (near(i - 1) == x["h"])) | F.coalesce(near(i + 1) == x["h"], F.lit(False)))
    places = F.sort_array(F.transform(twice, lambda x: x["i"]))
    rows = rows.withColumn("n_repeat_words", F.coalesce(_covered(places), F.lit(0)).cast("long")).drop("__sorted")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return rows.withColumn("base_failed", failed).select(
        *rest, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"
    )


def shrunk_rates(measured: DataFrame, host_col: str) -> DataFrame:
    """``host, n_docs, n_failed, rate``: the failure rate of each host under the fitted beta prior.

    Moments: the mean is that of all documents; the variance between hosts is that
    of their rates, weighted by size, less what chance alone gives. No variance
    beyond chance pools all hosts; one host alone keeps its own rate.
    """
    hosts = measured.groupBy(F.col(host_col).alias("host")).agg(
        F.count(F.lit(1)).alias("n_docs"), F.count_if("base_failed").alias("n_failed")
    )
    hosts = stored(hosts, "host-counts")
    sums = hosts.agg(
        F.count(F.lit(1)).alias("k"),
        F.sum("n_docs").alias("n"),
        F.sum("n_failed").alias("f"),
        F.sum(F.pow("n_docs", F.lit(2))).alias("nn"),
        F.sum(F.col("n_failed") * F.col("n_failed") / F.col("n_docs")).alias("ff"),
    ).first()
    alpha, beta = prior(sums["k"], sums["n"] or 0, sums["f"] or 0, sums["nn"] or 0.0, sums["ff"] or 0.0)
    rate = (F.col("n_failed") + F.lit(alpha)) / (F.col("n_docs") + F.lit(alpha + beta))
    return hosts.withColumn("rate", rate)


def prior(k: int, n: int, f: int, nn: float, ff: float, strongest: float = 1e6) -> tuple[float, float]:
    """Beta parameters by moments from hosts, documents, failures, sum of n^2 and sum of f^2/n."""
    if k < 2 or f == 0 or f == n:
        return 0.0, 0.0
    mean = f / n
    spread = ff - n * mean * mean
    between = (spread - (k - 1) * mean * (1 - mean)) / (n - nn / n)
    strength = strongest if between <= 0 else min(strongest, max(0.0, mean * (1 - mean) / between - 1))
    return mean * strength, (1 - mean) * strength


def judge(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    max_rate: float = MAX_RATE,
) -> DataFrame:
    """One row per document: the measures, ``base_failed``, ``host_rate`` and ``kept``."""
    chosen = docs.select(
        F.col(id_col).alias("doc_id"), F.col(text_col).alias("__text"), F.col(host_col).alias("__host")
    )
    measured = stored(measures(chosen, "__text"), "quality")
    rates = shrunk_rates(measured, "__host").select("host", F.col("rate").alias("host_rate"))
    joined = measured.join(rates, measured["__host"].eqNullSafe(rates["host"]), "left").drop("host", "__host")
    return joined.withColumn("kept", ~F.col("base_failed") & (F.col("host_rate") <= max_rate)).withColumnRenamed("doc_id", id_col)
