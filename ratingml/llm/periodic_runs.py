"""Periodic runs of words: a suffix automaton with link-cut access.

Words are appended one by one to a suffix automaton. Its suffix links form a tree; the
path from a new state to the root holds all suffixes of the text so far. A link-cut
tree keeps, for each stretch of such a path, the place where its words were last
seen ("colour"). Appending word ``i`` gives the whole path the colour ``i``; on the
way, each old stretch shows a length ``L`` and the end ``e`` of its last occurrence: the last ``L`` words
were also seen at distance ``d = i - e``. Where ``L >= 2 d`` the last ``L + d`` words
have period ``d``, at least three times over, and no smaller period (a smaller one would
have been seen later). The match is then extended to both sides to the whole run. Colours
change O(n log n) times in all, each at O(log n) amortised.

Only stretches of a text that can hold a run are appended. In a run of three periods and 24 words
every eight words occur again within the run, and its first eight words occur three
times; so words that no twice-met window of eight covers, and stretches without a window met three
times, hold no run. The windows are compared by 64-bit fingerprints; an accidental
match only leaves more to append.

Defined cases: null and empty texts have no words and no runs; null and repeated ids are
rows like any others; an empty table gives an empty table; extra columns are ignored, whatever their names. Runs are ordered by
start, then period.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratingml.llm.wordscan import scan, slices

WORD_BREAKS = b" \t\n\x0b\x0c\r"
MIN_WORDS = 24
MIN_PERIODS = 3
#: Words of the windows that say where a run may be; a third of MIN_WORDS, as the proof above needs.
_WINDOW = MIN_WORDS // MIN_PERIODS

Run = tuple[int, int, int]


class LinkTree:
    """The suffix links as a link-cut forest: each preferred path is a splay tree with one colour.

    A splay tree is ordered by depth. Its root holds the colour of the path and, as ``up``, the parent of the
    path's highest state. State 0 stands for none.
    """

    def __init__(self, size: int):
        self.above = [0] * size
        self.below = [0] * size
        self.up = [0] * size
        self.colour = [-1] * size

    def raise_to_top(self, x: int) -> None:
        """Splay ``x`` to the root of its tree."""
        above, below, up, colour = self.above, self.below, self.up, self.colour
        while True:
            y = up[x]
            if not y or (above[y] != x and below[y] != x):
                return
            z = up[y]
            if z and (above[z] == y or below[z] == y):
                # two levels at a time: the straight case turns the upper edge first
                self._turn(y if (above[z] == y) == (above[y] == x) else x)
            elif colour[x] != colour[y]:
                colour[x] = colour[y]
            self._turn(x)

    def _turn(self, x: int) -> None:
        above, below, up = self.above, self.below, self.up
        y = up[x]
        z = up[y]
        if above[y] == x:
            moved = below[x]
            above[y] = moved
            below[x] = y
        else:
            moved = above[x]
            below[y] = moved
            above[x] = y
        if moved:
            up[moved] = y
        up[y] = x
        up[x] = z
        if z:
            if above[z] == y:
                above[z] = x
            elif below[z] == y:
                below[z] = x
            else:
                self.colour[x] = self.colour[y]
        else:
            self.colour[x] = self.colour[y]

    def insert_above(self, new: int, x: int) -> None:
        """Put a new state between ``x`` and its parent; it was last seen where ``x`` was."""
        self.raise_to_top(x)
        top = self.above[x]
        self.above[new] = top
        if top:
            self.up[top] = new
        self.above[x] = new
        self.up[new] = x

    def access(self, x: int, colour: int) -> list[tuple[int, int]]:
        """Give the path from ``x`` to the root one colour; return ``(lowest state, old colour)`` of its old stretches."""
        above, below, up, colours = self.above, self.below, self.up, self.colour
        found = []
        lower, at = 0, x
        while at:
            self.raise_to_top(at)
            old = colours[at]
            if old >= 0:
                found.append((at, old))
            cut = below[at]
            if cut:
                colours[cut] = old
            below[at] = lower
            lower, at = at, up[at]
        colours[lower] = colour
        self.raise_to_top(x)
        return found


def repetitions(words: list[int], min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> list[Run]:
    """All runs ``(start, length, period)`` of ``min_words`` words and ``min_periods`` periods or more."""
    n = len(words)
    tree = LinkTree(2 * n + 2)
    root = 1
    link = [0] * (2 * n + 2)
    size = [0] * (2 * n + 2)
    follow: list[dict[int, int]] = [{}, {}]
    last, states = root, 1
    ends: dict[int, int] = {}
    runs: list[Run] = []
    factor = min_periods - 1
    for i, word in enumerate(words):
        states += 1
        new = states
        size[new] = i + 1
        follow.append({})
        p = last
        while p and word not in follow[p]:
            follow[p][word] = new
            p = link[p]
        if not p:
            link[new] = root
        else:
            q = follow[p][word]
            if size[q] == size[p] + 1:
                link[new] = q
            else:
                states += 1
                half = states
                size[half] = size[p] + 1
                follow.append(dict(follow[q]))
                link[half] = link[q]
                tree.insert_above(half, q)
                while p and follow[p].get(word) == q:
                    follow[p][word] = half
                    p = link[p]
                link[q] = link[new] = half
        tree.up[new] = link[new]
        last = new
        for state, end in tree.access(new, i):
            d = i - end
            if size[state] >= factor * d and ends.get(d, -1) < i:
                stop = i + 1
                while stop < n and words[stop] == words[stop - d]:
                    stop += 1
                begin = i - size[state] - d + 1
                while begin and words[begin - 1] == words[begin - 1 + d]:
                    begin -= 1
                ends[d] = stop - 1
                if stop - begin >= max(min_words, min_periods * d):
                    runs.append((begin, stop - begin, d))
    runs.sort(key=lambda r: (r[0], r[2]))
    return runs


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def stretches(ids: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int]]:
    """``(text, begin, end)``: the only places of the words ``ids`` where a run may be."""
    n = len(ids)
    if n < MIN_WORDS:
        return []
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    marks = _mixed(ids.astype(np.uint64) + np.uint64(1))
    step = 1
    while step < _WINDOW:
        marks = _mixed(marks[: len(marks) - step] * np.uint64(0xD6E8FEB86659FD93) + marks[step:])
        step *= 2
    whole = text[: len(marks)] == text[_WINDOW - 1 :]
    marks = _mixed(marks + _mixed(text[: len(marks)].astype(np.uint64) + np.uint64(7)))
    places = np.flatnonzero(whole)
    ordered = np.sort(marks[places])
    if len(ordered) < 2:
        return []
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return []
    thrice = twice[1:][twice[1:] == twice[:-1]]
    twice = np.unique(twice)
    chosen = marks[places]
    at = np.minimum(np.searchsorted(twice, chosen), len(twice) - 1)
    again = places[twice[at] == chosen]
    own = np.isin(marks[again], thrice)
    # neighbouring windows of one text make a stretch
    first = np.r_[True, (again[1:] != again[:-1] + 1) | (text[again[1:]] != text[again[:-1]])]
    heads = np.flatnonzero(first)
    tails = np.r_[heads[1:], len(again)] - 1
    often = np.logical_or.reduceat(own, heads)
    begins, ends = again[heads], again[tails] + _WINDOW
    kept = np.flatnonzero(often & (ends - begins >= MIN_WORDS))
    return [(int(text[begins[j]]), int(begins[j]), int(ends[j])) for j in kept]


@dataclass
class Found:
    n_words: int
    runs: list[Run]
    collapsed: str


def search(texts: pa.Array, screen: bool = True) -> list[Found]:
    """The runs of each text and the text without repeated periods, single-spaced."""
    words = scan(texts, WORD_BREAKS)
    found: dict[int, list[Run]] = {}
    if screen:
        places = stretches(words.ids, words.bounds)
    else:
        places = [(d, int(words.bounds[d]), int(words.bounds[d + 1])) for d in range(len(texts))]
    for d, begin, end in places:
        offset = begin - int(words.bounds[d])
        own = [(start + offset, length, period) for start, length, period in repetitions(words.ids[begin:end].tolist())]
        found.setdefault(d, []).extend(own)
    names = words.names.cast(pa.string())
    kept = np.ones(len(words.ids), bool)
    for d, runs in found.items():
        base = int(words.bounds[d])
        for start, length, period in runs:
            kept[base + start + period : base + start + length] = False
    chosen = np.flatnonzero(kept)
    flat = names.take(pa.array(words.ids[chosen])) if len(chosen) else pa.array([], pa.string())
    lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(chosen, words.bounds), pa.int32()), flat)
    joined = pc.binary_join(lists, " ").to_pylist()
    counts = np.diff(words.bounds).tolist()
    return [Found(n, sorted(found.get(d, []), key=lambda r: (r[0], r[2])), text) for d, (n, text) in enumerate(zip(counts, joined))]


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def with_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id, n_words, runs, collapsed``.

    ``collapsed`` is the text without the words that a run holds after its first period, single-spaced.
    """
    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = chosen.schema["id"].dataType.simpleString()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = search(part.column("text"))
                runs = [[{"start": s, "length": k, "period": p} for s, k, p in f.runs] for f in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id"),
                        pa.array([f.n_words for f in found], pa.int64()),
                        pa.array(runs, _RUNS),
                        pa.array([f.collapsed for f in found], pa.string()),
                    ],
                    names=["id", "n_words", "runs", "collapsed"],
                )

    schema = f"id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return chosen.mapInArrow(find, schema).withColumnRenamed("id", id_col)
