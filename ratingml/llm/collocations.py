"""Phrase collocations from sorted count streams.

Every place of the corpus gives one window: its word and up to three words that follow in
the same piece. Sorted windows are a count stream in prefix order: all windows that
begin with the same words stand together, so one scan with running sums counts the
phrases of one to four words, and nothing is looked up in a hash table. A phrase whose
windows lie across the border of two parts leaves a partial sum on either side.

Phrases met ``min_count`` times or more (a phrase is never more frequent than its
parts) are kept as two streams: in prefix order, sorted by their words, and in suffix order,
sorted by their words from the last one on. Merge joins of sorted streams then give, for
each candidate and each cut, the count of the words left and right of the cut, and for
each phrase the largest count among the phrases that extend it by a word on its right
(prefix order) or its left (suffix order). Longer extensions need no look: what holds
a phrase with two words more is counted at most as often as the phrase with one word more,
which is then a candidate too.

Defined cases: a null text is empty, a null language is ``und``; texts without words
count for nothing; repeated rows count each time; a table without candidates gives no rows;
extra columns are ignored, whatever their names; ids are not read. Equal scores are ordered by count, then by the
UTF-8 bytes of the phrase.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratingml.llm.common import stored
from ratingml.llm.wordscan import scan, slices

WORD_BREAKS = b" \t"
PIECE_BREAKS = b".,;:!?\n\x0b\x0c\r"
MAX_WORDS = 4
MIN_COUNT = 30
TOP = 2000
#: Share of a phrase's places, in percent, that a longer candidate takes to drop it.
COVERED_PERCENT = 80
SCALE = 2_000_000

#: A window met this often in one slice waits in its task, so that frequent ones leave it once.
_OFTEN = 16
#: Waiting windows before a task lets them go.
_WAITING = 100_000

_STREAM = "key string, c long"
_COUNTS = "key string, k int, c long"


def window_counts(texts: pa.Array, langs: list[str]) -> tuple[pa.Array, np.ndarray]:
    """Distinct windows of the texts with their counts.

    A key is the language, a tab, and each word with a space behind it, so that in byte
    order all keys that begin with the same words stand together. The bare language counts words.
    """
    words = scan(texts, WORD_BREAKS, PIECE_BREAKS, lower=True)
    n = len(words.ids)
    names = sorted(set(langs))
    of_text = np.array([names.index(x) for x in langs], np.int64) if len(names) < 2 else _places(langs, names)
    lang = np.repeat(of_text, np.diff(words.bounds))
    totals = np.bincount(lang, minlength=len(names))
    ids = words.ids.astype(np.int64) + 1
    columns, linked = [ids], np.ones(n, bool)
    for step in range(1, MAX_WORDS):
        linked = linked.copy()
        rest = max(0, n - step)
        linked[rest:] = False
        linked[:rest] &= words.pieces[n - rest :] == words.pieces[:rest]
        shifted = np.zeros(n, np.int64)
        shifted[:rest] = ids[n - rest :]
        columns.append(np.where(linked, shifted, 0))
    radix = len(words.names) + 1
    head = (lang * radix + columns[0]) * radix + columns[1]
    tail = columns[2] * radix + columns[3]
    order = np.lexsort((tail, head))
    head, tail = head[order], tail[order]
    first = np.flatnonzero(np.r_[True, (head[1:] != head[:-1]) | (tail[1:] != tail[:-1])]) if n else np.empty(0, np.int64)
    counts = np.diff(np.r_[first, n])
    at = order[first]
    marked = pa.array([quote(x, safe="") + "\t" for x in names], pa.large_string())
    # slot 0 is "no word", without a space behind it
    spaced = pc.binary_join_element_wise(words.names.cast(pa.large_string()), _text(""), _text(" "))
    spaced = pa.concat_arrays([pa.array([""], pa.large_string()), spaced])
    parts = [marked.take(pa.array(lang[at])), *[spaced.take(pa.array(c[at])) for c in columns]]
    keys = pc.binary_join_element_wise(*parts, _text(""))
    return pa.concat_arrays([keys, marked]), np.r_[counts, totals]


def _text(value: str) -> pa.Scalar:
    return pa.scalar(value, pa.large_string())


def _places(langs: list[str], names: list[str]) -> np.ndarray:
    place = {x: i for i, x in enumerate(names)}
    return np.array([place[x] for x in langs], np.int64)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    waiting: Counter[str] = Counter()

    def released() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays(
            [pa.array(list(waiting), pa.string()), pa.array(list(waiting.values()), pa.int64())], names=["key", "c"]
        )
        waiting.clear()
        return out

    for batch in batches:
        for part in slices(batch, "text"):
            keys, counts = window_counts(part.column("text"), part.column("lang").to_pylist())
            often = counts >= _OFTEN
            for key, c in zip(keys.filter(pa.array(often)).to_pylist(), counts[often].tolist()):
                waiting[key] += c
            rare = pa.array(~often)
            yield pa.RecordBatch.from_arrays(
                [keys.filter(rare).cast(pa.string()), pa.array(counts[~often], pa.int64())], names=["key", "c"]
            )
            if len(waiting) > _WAITING:
                yield released()
    yield released()


def phrase_counts(keys: pa.Array, counts: np.ndarray, min_count: int) -> list[tuple[str, int, int]]:
    """``(phrase, words, count)`` from a sorted stretch of the stream in prefix order.

    A phrase at either end of the stretch may go on outside, so it is given with
    whatever count it has here; others only where they reach ``min_count``.
    """
    n = len(keys)
    out: list[tuple[str, int, int]] = []
    if not n:
        return out
    split = pc.split_pattern(keys, " ")
    offsets = split.offsets.to_numpy()
    flat = split.values
    # the piece behind the last space is empty; a bare language has no space and no word
    n_words = np.diff(offsets) - 1
    bare = np.flatnonzero(n_words == 0)
    for i in bare.tolist():
        out.append((keys[i].as_py(), 0, int(counts[i])))
    same = np.ones(n, bool)
    same[0] = False
    for k in range(1, MAX_WORDS + 1):
        has = n_words >= k
        same &= has
        same[1:] &= has[:-1]
        check = np.flatnonzero(same)
        if len(check):
            here = flat.take(pa.array(offsets[check] + k - 1))
            above = flat.take(pa.array(offsets[check - 1] + k - 1))
            same[check] = pc.equal(here, above).to_numpy(zero_copy_only=False)
        rows = np.flatnonzero(has)
        if not len(rows):
            break
        heads = np.flatnonzero(~same[rows])
        sums = np.add.reduceat(counts[rows], heads)
        lasts = rows[np.r_[heads[1:], len(rows)] - 1]
        firsts = rows[heads]
        kept = np.flatnonzero((sums >= min_count) | (firsts == 0) | (lasts == n - 1))
        for g in kept.tolist():
            i = int(firsts[g])
            words = flat.slice(int(offsets[i]), k).to_pylist()
            out.append((" ".join(words), k, int(sums[g])))
    return out


def frequent_phrases(docs: DataFrame, min_count: int = MIN_COUNT, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``lang, k, phrase, c``: phrases of up to four words met ``min_count`` times; ``k = 0`` counts all words."""
    chosen = docs.select(
        F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang")
    )
    stream = chosen.mapInArrow(_windows, _STREAM).repartitionByRange("key").sortWithinPartitions("key")

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = phrase_counts(batch.column("key"), batch.column("c").to_numpy(), min_count)
            keys, sizes, counts = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.string()), pa.array(sizes, pa.int32()), pa.array(counts, pa.int64())], names=["key", "k", "c"]
            )

    parts = stream.mapInArrow(summed, _COUNTS)
    whole = parts.groupBy("key", "k").agg(F.sum("c").alias("c")).filter((F.col("k") == 0) | (F.col("c") >= min_count))
    # the language ends at the only tab of a key
    lang = F.url_decode(F.substring_index("key", "\t", 1)).alias("lang")
    return whole.select(lang, "k", F.substring_index("key", "\t", -1).alias("phrase"), "c")


def _joined_words(words: str, first: str, count: str):
    return F.expr(f"array_join(slice({words}, {first}, {count}), ' ')")


def scored(docs: DataFrame, min_count: int = MIN_COUNT, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """All candidates that no longer one covers: ``lang, phrase, a, l, r, n, score``."""
    counted = stored(frequent_phrases(docs, min_count, text_col, lang_col), "phrases")
    totals = counted.filter("k = 0").select("lang", F.col("c").alias("n"))
    words = F.split("phrase", " ")
    grams = counted.filter("k > 0").select("lang", "phrase", "k", "c", words.alias("words"), F.array_join(F.reverse(words), " ").alias("back"))
    # the two streams; merge joins and sorted aggregates read them in step
    prefix_order = stored(grams.repartitionByRange("lang", "phrase").sortWithinPartitions("lang", "phrase"), "prefix-order")
    suffix_order = stored(grams.repartitionByRange("lang", "back").sortWithinPartitions("lang", "back"), "suffix-order")
    longer = prefix_order.filter("k > 1")
    cuts = longer.select("lang", "phrase", F.col("c").alias("a"), "words", "k", F.explode(F.expr("sequence(1, k - 1)")).alias("cut"))
    cuts = cuts.select(
        "lang", "phrase", "a", "cut", _joined_words("words", "1", "cut").alias("head"), _joined_words("words", "cut + 1", "k - cut").alias("rest")
    )
    lefts = prefix_order.select("lang", F.col("phrase").alias("head"), F.col("c").alias("l"))
    rights = suffix_order.select("lang", F.col("phrase").alias("rest"), F.col("c").alias("r"))
    both = cuts.join(lefts.hint("merge"), ["lang", "head"]).join(rights.hint("merge"), ["lang", "rest"])
    # decimals: the products may not fit 64 bits
    score = F.expr(f"({SCALE} * CAST(a AS DECIMAL(20, 0))) div (CAST(l AS DECIMAL(20, 0)) + CAST(r AS DECIMAL(20, 0)))")
    lowest = both.groupBy("lang", "phrase").agg(F.min(F.struct(score.alias("score"), "cut", "a", "l", "r")).alias("best"))
    right = longer.groupBy("lang", _joined_words("words", "1", "k - 1").alias("phrase")).agg(F.max("c").alias("x"))
    left = suffix_order.filter("k > 1").groupBy("lang", _joined_words("words", "2", "k - 1").alias("phrase")).agg(F.max("c").alias("x"))
    extended = right.unionByName(left).groupBy("lang", "phrase").agg(F.max("x").alias("x"))
    open_ = lowest.join(extended.hint("merge"), ["lang", "phrase"], "left")
    free = F.expr(f"x IS NULL OR 100 * CAST(x AS DECIMAL(20, 0)) < {COVERED_PERCENT} * CAST(best.a AS DECIMAL(20, 0))")
    return open_.filter(free).join(totals, "lang").select("lang", "phrase", "best.a", "best.l", "best.r", "n", "best.score")


def collocations(
    docs: DataFrame, top: int = TOP, min_count: int = MIN_COUNT, text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """Each language's first ``top`` phrases: ``lang, rank, phrase, a, l, r, n, score``."""
    found = scored(docs, min_count, text_col, lang_col).withColumn("__part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # the first rows of each of 64 parts hold the first rows of all
    near = found.withColumn("__place", F.row_number().over(Window.partitionBy("lang", "__part").orderBy(*order)))
    ranked = near.filter(F.col("__place") <= top).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    return ranked.filter(F.col("rank") <= top).select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score")
    )
