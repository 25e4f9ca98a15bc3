"""Benchmark passages in training text, found through an FM-index per training shard.

A shard is one Arrow batch of documents. Its words become numbers: words of the
benchmark get their own, runs of other words become one break, and the ends of
documents are breaks. The shard's suffixes are sorted (prefix doubling in numpy),
the Burrows-Wheeler sequence goes into a wavelet matrix with rank counts, and the
place of every ``SAMPLE``-th suffix is kept. All windows of the benchmark are then
searched backwards at once; rows of the index that match are walked to the nearest
sampled suffix, which gives their place. The places are merged into word spans.

Windows: 10 consecutive words of an item; an item of 1 to 9 words is one window.

The benchmark is collected and sent to all tasks; its size is checked against
``max_phrase_bytes`` first. Documents are never shuffled; an index lives as long as
its task, and a lost task builds it again from its rows.

Defined results: a null or empty text has no words and no hit. Equal texts in a
shard are indexed once. Items without words match nothing; items with equal text
all count. A null item_id is left out of the list of items.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 10
SAMPLE = 8
MAX_PHRASE_BYTES = 64 << 20
#: Words that one index may hold; a larger batch is cut into several shards.
SHARD_WORDS = 4_000_000

#: A-Z in lower case; digits, a-z and all bytes of other characters stay; the rest parts words.
_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


class Phrases(NamedTuple):
    """Distinct windows as rows of word numbers (right-aligned, zero-filled), and the items of each."""

    numbers: dict[bytes, int]
    windows: np.ndarray
    lengths: np.ndarray
    owners: list[tuple[int, ...]]
    items: list[str]


def phrases_of(items: list[tuple[object, str | None]]) -> Phrases:
    numbers: dict[bytes, int] = {}
    owners: dict[tuple[int, ...], set[int]] = {}
    names = []
    for place, (name, text) in enumerate(items):
        names.append("" if name is None else str(name))
        # 0 ends the sequence, 1 is a break, words follow
        found = [numbers.setdefault(w, len(numbers) + 2) for w in words_of(text)]
        for at in range(max(1, len(found) - WINDOW + 1) if found else 0):
            owners.setdefault(tuple(found[at : at + WINDOW]), set()).add(place)
    lengths = np.array([len(w) for w in owners], np.int64)
    windows = np.zeros((len(owners), WINDOW), np.int64)
    for row, window in enumerate(owners):
        windows[row, WINDOW - len(window) :] = window
    return Phrases(numbers, windows, lengths, [tuple(sorted(o)) for o in owners.values()], names)


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Start places of all suffixes in order; the last symbol must be the only 0."""
    n = len(symbols)
    width = max(1, int(symbols.max()).bit_length())
    packed = min(n, 62 // width)
    key = np.zeros(n, np.int64)
    for step in range(packed):
        key <<= width
        key[: n - step] |= symbols[step:]
    order = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int64)

    def regroup(rows: np.ndarray, keys: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Rank every row by the first row of its group; give the mask of rows not alone."""
        new = np.empty(len(rows), bool)
        new[0] = True
        np.not_equal(keys[1:], keys[:-1], out=new[1:])
        starts = np.flatnonzero(new)
        rank[rows] = first[starts][np.cumsum(new) - 1]
        return ~(new & np.append(new[1:], True))

    open_ = regroup(order, key[order], np.arange(n))
    place = np.flatnonzero(open_)
    step = packed
    while len(place):
        rows = order[place]
        keys = rank[rows] * n + rank[np.minimum(rows + step, n - 1)]
        by = np.argsort(keys, kind="stable")
        rows, keys = rows[by], keys[by]
        order[place] = rows
        open_ = regroup(rows, keys, place)
        place = place[open_]
        step *= 2
    return order


class Bits:
    """A bit sequence with the number of ones before any place."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def ones(self, places: np.ndarray) -> np.ndarray:
        word, bit = places >> 6, (places & 63).astype(np.uint64)
        mask = (np.uint64(1) << bit) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)

    def at(self, places: np.ndarray) -> np.ndarray:
        return (self.words[places >> 6] >> (places & 63).astype(np.uint64)) & np.uint64(1) == 1


class FMIndex:
    """Backward search over one sequence of numbers that ends with its only 0."""

    def __init__(self, symbols: np.ndarray, sample: int = SAMPLE):
        order = suffix_order(symbols)
        last = symbols[order - 1]
        self.n = len(symbols)
        self.counts = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=int(symbols.max()) + 1))])
        self.levels: list[tuple[int, Bits, int]] = []
        for bit in range(int(symbols.max()).bit_length() - 1, -1, -1):
            ones = (last >> bit) & 1 == 1
            self.levels.append((bit, Bits(ones), int(len(last) - ones.sum())))
            last = np.concatenate([last[~ones], last[ones]])
        sampled = order % sample == 0
        self.sampled = Bits(sampled)
        self.places = order[sampled]

    def rank(self, symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its place in the Burrows-Wheeler sequence."""
        start = np.zeros(len(places), np.int64)
        for bit, bits, zeros in self.levels:
            one = (symbols >> bit) & 1 == 1
            a, b = bits.ones(start), bits.ones(places)
            start = np.where(one, zeros + a, start - a)
            places = np.where(one, zeros + b, places - b)
        return places - start

    def before(self, rows: np.ndarray) -> np.ndarray:
        """The row of the suffix one place to the left."""
        symbols = np.zeros(len(rows), np.int64)
        at = rows
        for bit, bits, zeros in self.levels:
            one, ones = bits.at(at), bits.ones(at)
            symbols |= one.astype(np.int64) << bit
            at = np.where(one, zeros + ones, at - ones)
        return self.counts[symbols] + self.rank(symbols, rows)

    def search(self, windows: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of the windows that occur, and their row ranges in the index."""
        top = len(self.counts) - 1
        alive = np.flatnonzero((lengths > 0) & ((windows < top).all(1)))
        last = windows[alive, -1]
        low, high = self.counts[last], self.counts[last + 1]
        for step in range(1, windows.shape[1] + 1):
            keep = low < high
            alive, low, high = alive[keep], low[keep], high[keep]
            if step == windows.shape[1] or not len(alive):
                break
            going = np.flatnonzero(lengths[alive] > step)
            symbols = windows[alive[going], -1 - step]
            low[going] = self.counts[symbols] + self.rank(symbols, low[going])
            high[going] = self.counts[symbols] + self.rank(symbols, high[going])
        return alive, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Start place of the suffix of each row: walk left to a sampled one and add the steps."""
        found = np.empty(len(rows), np.int64)
        waiting, at, steps = np.arange(len(rows)), rows, 0
        while len(waiting):
            hit = self.sampled.at(at)
            found[waiting[hit]] = self.places[self.sampled.ones(at[hit])] + steps
            waiting, at = waiting[~hit], self.before(at[~hit])
            steps += 1
        return found


class Hits(NamedTuple):
    """Of one text: its number of words, merged word spans and the item numbers."""

    n_words: int
    spans: list[tuple[int, int]]
    items: set[int]


def search_shard(texts: list[str | None], phrases: Phrases) -> list[Hits]:
    """Index the texts of one shard and find all windows in them."""
    number_of = phrases.numbers.get
    n_words, numbers, doc_of = [], [], []
    for doc, text in enumerate(texts):
        words = words_of(text)
        n_words.append(len(words))
        numbers.append(np.fromiter(map(number_of, words, repeat(1)), np.int64, len(words)))
        doc_of.append(np.full(len(words) + 1, doc, np.int32))
        numbers.append(np.ones(1, np.int64))
    whole = np.concatenate(numbers) if numbers else np.zeros(0, np.int64)
    hits = [Hits(n, [], set()) for n in n_words]
    # a run of breaks is one break
    kept = np.flatnonzero((whole != 1) | (np.append(1, whole[:-1]) != 1))
    if not len(kept) or not len(phrases.lengths):
        return hits
    index = FMIndex(np.append(whole[kept], 0))
    found, low, high = index.search(phrases.windows, phrases.lengths)
    if not len(found):
        return hits
    counts = high - low
    first = np.repeat(low - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
    rows = first + np.arange(counts.sum())
    places = kept[index.locate(rows)]
    window_of = np.repeat(found, counts)
    # spans over the words of the whole shard, merged by running sums
    depth = np.zeros(len(whole) + 1, np.int64)
    np.add.at(depth, places, 1)
    np.add.at(depth, places + phrases.lengths[window_of], -1)
    covered = np.cumsum(depth[:-1]) > 0
    edges = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(np.int8), [0]])))
    doc_at = np.concatenate(doc_of)
    offsets = np.concatenate([[0], np.cumsum(np.array(n_words) + 1)])
    for start, end in zip(edges[::2].tolist(), edges[1::2].tolist()):
        doc = int(doc_at[start])
        hits[doc].spans.append((start - int(offsets[doc]), end - int(offsets[doc])))
    for doc, window in np.unique(np.stack([doc_at[places], window_of], 1), axis=0).tolist():
        hits[doc].items.update(phrases.owners[window])
    return hits


def search_texts(texts: list[str | None], phrases: Phrases, shard_words: int = SHARD_WORDS) -> list[Hits]:
    """Search distinct texts once each, in shards of bounded size."""
    place: dict[str, int] = {}
    for text in texts:
        place.setdefault(text or "", len(place))
    found: list[Hits] = []
    shard: list[str] = []
    size = 0
    for text in place:
        if shard and size + len(text) > 6 * shard_words:
            found += search_shard(shard, phrases)
            shard, size = [], 0
        shard.append(text)
        size += len(text)
    if shard:
        found += search_shard(shard, phrases)
    return [found[place[text or ""]] for text in texts]


def collected_phrases(benchmark: DataFrame, max_phrase_bytes: int = MAX_PHRASE_BYTES) -> Phrases:
    """The benchmark's windows, after a check of its size."""
    items = benchmark.select("item_id", "text")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > max_phrase_bytes:
        raise ValueError(f"the benchmark has {size} bytes of text; max_phrase_bytes is {max_phrase_bytes}")
    rows = [tuple(r) for r in items.collect()]
    return phrases_of(sorted(rows, key=lambda r: (r[0] is None, str(r[0]), r[1] or "")))


def matched(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_phrase_bytes: int = MAX_PHRASE_BYTES
) -> DataFrame:
    """One row per document: ``id, n_words, n_hit, items, spans``; spans are half-open in words."""
    shared = docs.sparkSession.sparkContext.broadcast(collected_phrases(benchmark, max_phrase_bytes))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        phrases = shared.value
        for batch in batches:
            hits = search_texts([t if isinstance(t, str) else None for t in batch["__text"]], phrases)
            yield pd.DataFrame(
                {
                    "__id": batch["__id"],
                    "n_words": [h.n_words for h in hits],
                    "n_hit": [sum(e - s for s, e in h.spans) for h in hits],
                    "items": [sorted({phrases.items[i] for i in h.items} - {""}) for h in hits],
                    "spans": [[{"start": s, "end": e} for s, e in h.spans] for h in hits],
                }
            )

    chosen = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    kind = chosen.schema["__id"].dataType.simpleString()
    out = chosen.mapInPandas(
        search, f"__id {kind}, n_words long, n_hit long, items array<string>, spans array<struct<start: int, end: int>>"
    )
    return out.withColumnRenamed("__id", id_col)


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans; a cut leaves a line end between the parts."""
    data = text.encode("utf-8", "surrogatepass")
    plain = data.translate(_TABLE)
    starts, ends, at = [], [], 0
    for word in plain.split():
        at = plain.index(word, at)
        starts.append(at)
        at += len(word)
        ends.append(at)
    parts, done = [], 0
    for start, end in spans:
        parts.append(data[done : starts[start]].rstrip())
        done = ends[end - 1]
    parts.append(data[done:])
    return b"\n".join(p for p in parts if p.strip()).decode("utf-8", "surrogatepass")


def without_passages(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", max_phrase_bytes: int = MAX_PHRASE_BYTES) -> DataFrame:
    """The documents with all benchmark spans cut out of their texts, until none is left.

    ``n_chars`` follows where it is present. Untouched texts stay as they are.
    """
    shared = docs.sparkSession.sparkContext.broadcast(collected_phrases(benchmark, max_phrase_bytes))

    @F.pandas_udf("string")
    def cleaned(texts: pd.Series) -> pd.Series:
        out = [t if isinstance(t, str) else None for t in texts]
        waiting = list(range(len(out)))
        while waiting:
            hits = search_texts([out[i] for i in waiting], shared.value)
            # a cut joins two parts, which may make a new passage
            waiting = [i for i, h in zip(waiting, hits) if h.spans]
            spans = [h.spans for h in hits if h.spans]
            for i, own in zip(waiting, spans):
                out[i] = cut(out[i], own)
        return pd.Series(out, dtype="object")

    done = docs.withColumn(text_col, cleaned(F.col(text_col)))
    return done.withColumn("n_chars", F.length(text_col).cast("long")) if "n_chars" in docs.columns else done


def digest(items: list[str]) -> str:
    """SHA-256 of sorted item names, comma-joined."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
