"""Toxicity by a factorization machine over hashed terms.

A text is the set of its lower-cased words and of their first four and five
letters (stems), each hashed into ``BUCKETS``. The machine scores a set ``x`` as

    b + sum_i w[i] + 1/2 * (|sum_i v[i]|^2 - sum_i |v[i]|^2),

so pairs of terms count as well as single ones: the inner product of their factors
is learned even for pairs that no labelled text holds.

Fitting: on at most ``max_rows`` labelled rows (those with the smallest hash of
their id), a documented bound, so one task can learn from the hashed sets. Terms in
fewer than ``MIN_ROWS`` of these rows get no weight; all others are learned, also those whose own
share of toxic rows is that of chance, since a pair of them may tell. Scoring: every row, whole
text; the model (a few MB, at most ``BUCKETS`` entries) goes along with the tasks.

Defined results: a null or empty text has no term and scores by the bias alone.
Rows without a label are only scored; of several labels for one id the highest
counts. No labelled row at all gives a model that scores 0.5 less a margin (0.269).
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 20
RANK = 4
MAX_ROWS = 8_000
MIN_ROWS = 4
EPOCHS = 150
BATCH = 256
RATE = 0.3
#: The penalty of the last epochs, and those of weights and factors in the first ones, which tell the terms that count.
L1 = 2e-5
SELECTING = 60
SELECTING_L1 = (1.5e-3, 2e-3)
#: Of the first epochs, every so many reads all terms; the others those that are not at 0.
ALL_TERMS = 10
#: Least value of a term, so that pairs of words of many texts can be learned.
MIN_VALUE = 0.4
#: Spread of the first factors: at 0 no pair would ever be learned.
START = 0.1
THRESHOLD = 0.7
#: Tokens whose terms a scoring process remembers.
REMEMBERED = 400_000

#: Keep the buckets of stems apart from those of words.
_STEM_4, _STEM_5 = 0x9E3779B9, 0x7F4A7C15
_WORD = re.compile(r"[^\W_]+")


class Model(NamedTuple):
    """Weights of the buckets in use; ``row`` of a bucket is its place in ``buckets``."""

    bias: float
    buckets: np.ndarray
    weights: np.ndarray
    factors: np.ndarray


def terms(token: str) -> list[int]:
    """Buckets of the words in a token and of their stems."""
    lower = token.lower()
    found = []
    for word in (lower,) if lower.isalpha() else _WORD.findall(lower):
        if len(word) < 5:
            found.append(zlib.crc32(word.encode()) % BUCKETS)
        else:
            four = zlib.crc32(word[:4].encode())
            five = zlib.crc32(word[4].encode(), four)
            found += [(four ^ _STEM_4) % BUCKETS, (five ^ _STEM_5) % BUCKETS, zlib.crc32(word[5:].encode(), five) % BUCKETS]
    return found


class _Remembered(dict):
    """Token to buckets (or to rows of a model), computed once per token."""

    def __init__(self, row_of: np.ndarray | None = None):
        super().__init__()
        self.row_of = row_of

    def __missing__(self, token: str):
        found = terms(token)
        if self.row_of is not None:
            found = [int(r) for r in self.row_of[found] if r >= 0] if found else found
        if len(self) >= REMEMBERED:
            self.clear()
        self[token] = found
        return found


def _set_of(text: str | None, known: _Remembered) -> np.ndarray:
    rows = set().union(*filter(None, map(known.__getitem__, set((text or "").split()))))
    return np.fromiter(sorted(rows), np.int32, len(rows))


def is_held_out(id_col: Column) -> Column:
    """Rows whose crc32 of the id as text leaves 1 when divided by 3 are never learned from."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn(sets: list[np.ndarray], labels: np.ndarray, seed: int = 7) -> Model:
    """Adaptive gradient steps on the logistic loss with a soft threshold, in one fixed order per epoch.

    A high threshold in the first epochs leaves the terms that count, alone or in pairs; the others are fitted on these.
    """
    n = len(sets)
    share = float(labels.mean()) if n else 0.0
    bias = math.log(share / (1 - share)) if 0 < share < 1 else -1.0
    lengths = np.array([len(x) for x in sets], np.int64)
    terms_of = np.concatenate(sets).astype(np.int64) if n else np.zeros(0, np.int64)
    seen, place, counts = np.unique(terms_of, return_inverse=True, return_counts=True)
    kept = (counts >= MIN_ROWS) & (0 < share < 1)
    buckets, m = seen[kept].astype(np.int32), int(kept.sum())
    rng = np.random.default_rng(seed)
    w, v = np.zeros(m), rng.normal(0, START, (m, RANK))
    if m == 0:
        return Model(bias, buckets, w, v)
    # rare terms weigh more than words of every text
    value = np.maximum(np.log((n + 1) / counts[kept]) / math.log(n + 1), MIN_VALUE)
    row_of = np.full(len(seen), -1, np.int64)
    row_of[kept] = np.arange(m)
    ends = np.concatenate([[0], np.cumsum(lengths)])
    known = row_of[place]
    every = [own[own >= 0] for own in (known[ends[i] : ends[i + 1]] for i in range(n))]
    rows, paired, (l1_w, l1_v) = every, np.ones((m, 1)), SELECTING_L1
    sums_w, sums_v, sum_b = np.full(m, 1e-2), np.full((m, RANK), 1e-2), 1e-2
    for epoch in range(EPOCHS):
        if epoch == SELECTING:
            live = (w != 0) | (v != 0).any(1)
            m, row_of = int(live.sum()), np.where(live, np.cumsum(live) - 1, -1)
            rows = [own[own >= 0] for own in (row_of[r] for r in every)]
            buckets, value, w, v, sums_w, sums_v = (x[live] for x in (buckets, value, w, v, sums_w, sums_v))
            paired, l1_w, l1_v = (v != 0).any(1, keepdims=True), L1, L1
        elif epoch < SELECTING and epoch % ALL_TERMS == 0:
            rows = every
        elif epoch < SELECTING and epoch % ALL_TERMS == 1:
            live = (w != 0) | (v != 0).any(1)
            rows = [own[live[own]] for own in every]
        order = rng.permutation(n)
        for start in range(0, n, BATCH):
            chosen = order[start : start + BATCH]
            at = np.concatenate([rows[i] for i in chosen])
            doc = np.repeat(np.arange(len(chosen)), [len(rows[i]) for i in chosen])
            x = value[at]
            own = v[at] * x[:, None]
            total = np.stack([np.bincount(doc, own[:, f], len(chosen)) for f in range(RANK)], 1)
            squares = np.bincount(doc, (own**2).sum(1), len(chosen))
            z = bias + np.bincount(doc, w[at] * x, len(chosen)) + 0.5 * ((total**2).sum(1) - squares)
            slope = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[chosen]
            per_term = slope[doc] * x / len(chosen)
            g = np.bincount(at, per_term, m)
            sums_w += g * g
            w = _shrunk(w - RATE * g / np.sqrt(sums_w), RATE * l1_w / np.sqrt(sums_w))
            for f in range(RANK):
                g = np.bincount(at, per_term * (total[doc, f] - own[:, f]), m)
                sums_v[:, f] += g * g
                pace = RATE / np.sqrt(sums_v[:, f])
                v[:, f] = _shrunk(v[:, f] - pace * g, pace * l1_v) * paired[:, 0]
            g = slope.mean()
            sum_b += g * g
            bias -= RATE * g / math.sqrt(sum_b)
    # the values go into the weights, so scoring needs the sets only
    return Model(float(bias), buckets, (w * value).astype(np.float32), (v * value[:, None]).astype(np.float32))


def _shrunk(values: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Towards 0, so that terms without a say end at 0 and long texts gather no noise."""
    return np.sign(values) * np.maximum(np.abs(values) - by, 0)


def score_set(rows: np.ndarray, model: Model) -> float:
    """Probability for one set of model rows."""
    z = model.bias
    if len(rows):
        v = model.factors[rows].astype(np.float64)
        z += float(model.weights[rows].astype(np.float64).sum()) + 0.5 * float((v.sum(0) ** 2).sum() - (v**2).sum())
    return 1 / (1 + math.exp(-min(max(z, -30.0), 30.0)))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """Learn from at most ``max_rows`` labelled ids that are not held out, one text each."""
    marked = labels.select(F.col("doc_id").alias("__id"), F.col("toxic").cast("int").alias("__y"))
    marked = marked.filter(F.col("__id").isNotNull() & F.col("__y").isNotNull() & ~is_held_out(F.col("__id")))
    marked = marked.groupBy("__id").agg(F.max("__y").alias("__y"))
    # ids and labels only, so the bounded list is small enough to send to all tasks
    chosen = marked.orderBy(F.xxhash64("__id"), "__id").limit(max_rows)
    texts = docs.select(F.col("doc_id").alias("__id"), F.col("text").alias("__text"))
    # an id has one text, whatever the order of the rows: of several, which only a faulty table has, that of the smallest hash
    rows = texts.join(F.broadcast(chosen), "__id").groupBy("__id", "__y").agg(
        F.min(F.struct(F.xxhash64("__text").alias("hash"), "__text")).alias("__one")
    )
    rows = rows.select("__id", "__y", F.col("__one.__text").alias("__text"))

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _Remembered()
        for batch in batches:
            sets = [_set_of(t if isinstance(t, str) else None, known) for t in batch["__text"]]
            yield pd.DataFrame({"id": batch["__id"], "y": batch["__y"], "terms": sets})

    def learned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(batches)
        whole = pd.concat(parts).sort_values("id") if parts else None
        sets = [np.asarray(t, np.int32) for t in whole["terms"]] if whole is not None else []
        y = whole["y"].to_numpy(np.float64) if whole is not None else np.zeros(0)
        model = learn(sets, (y > 0).astype(np.float64))
        yield pd.DataFrame(
            {
                "bias": [model.bias],
                "buckets": [np.asarray(model.buckets, "<i4").tobytes()],
                "weights": [np.asarray(model.weights, "<f4").tobytes()],
                "factors": [np.asarray(model.factors, "<f4").tobytes()],
            }
        )

    sets = rows.mapInPandas(hashed, "id long, y int, terms array<int>")
    # hashing stays parallel; only the bounded sample of sets meets in one task
    row = sets.repartition(1).mapInPandas(learned, "bias double, buckets binary, weights binary, factors binary").first()
    return Model(
        row["bias"],
        np.frombuffer(row["buckets"], "<i4"),
        np.frombuffer(row["weights"], "<f4"),
        np.frombuffer(row["factors"], "<f4").reshape(-1, RANK),
    )


def scored(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """Add ``score``; the labels and all other columns stay out of it."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = shared.value
        row_of = np.full(BUCKETS, -1, np.int32)
        row_of[own.buckets] = np.arange(len(own.buckets))
        known = _Remembered(row_of)
        for texts in batches:
            yield pd.Series([score_set(_set_of(t, known), own) for t in texts], dtype="float64")

    return docs.withColumn(score_col, score(F.col(text_col)))


def predicted(score: Column, threshold: float = THRESHOLD) -> Column:
    return (score >= threshold).cast("int")
