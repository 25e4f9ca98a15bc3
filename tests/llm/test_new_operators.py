"""Exact shards, collocations and periodic runs against brute force, with their edge cases."""

import random
import re
from collections import Counter
from fractions import Fraction
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest

from ratingml.llm import collocations, periodic_runs, queries, uniform_shards
from ratingml.llm.wordscan import scan, slices

WORDS = re.compile("[^\x20\x09-\x0d]+")


# ---------------------------------------------------------------- words of a batch


def test_scanned_words_are_those_of_a_pattern():
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab é\t\n\x0b.,\x01\x1c漢 ") for _ in range(rng.randrange(40))) for _ in range(300)]
    texts += [None, "", " ", "x" * 1000, "end"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
    seen = []
    for part in slices(batch, "text", 100):
        words = scan(part.column("text"), b" \t\n\x0b\x0c\r")
        names = [x.decode() for x in words.names.to_pylist()]
        for d in range(part.num_rows):
            seen.append([names[i] for i in words.ids[words.bounds[d] : words.bounds[d + 1]]])
    assert seen == [WORDS.findall(t or "") for t in texts]


# ---------------------------------------------------------------- op11


def test_matrix_has_exact_margins_and_the_right_law():
    counts = np.array([3, 0, 5, 2, 10])
    sizes = uniform_shards.shard_sizes(20, 3)
    ends = np.cumsum(counts)
    first = Counter()
    for seed in range(2000):
        rows = np.array([uniform_shards.matrix_row(ends, sizes, p, seed) for p in range(5)])
        assert (rows.sum(axis=1) == counts).all() and (rows.sum(axis=0) == sizes).all() and (rows >= 0).all()
        first[int(rows[0, 0])] += 1
    # three rows into a shard of 7 of 20 places: the hypergeometric law
    expected = [13 * 12 * 11, 3 * 7 * 13 * 12, 3 * 7 * 6 * 13, 7 * 6 * 5]
    chi = sum((first[k] - 2000 * e / 6840) ** 2 / (2000 * e / 6840) for k, e in enumerate(expected))
    assert chi < 16.3


@pytest.mark.parametrize("good, bad, taken", [(40, 70, 30), (5, 500, 100), (300, 20, 310), (1000, 1000, 1000)])
def test_large_population_sampler_has_the_law(monkeypatch, good, bad, taken):
    from math import comb

    monkeypatch.setattr(uniform_shards, "NUMPY_LIMIT", 0)
    rng = np.random.default_rng(3)
    seen = Counter(uniform_shards.hypergeometric(rng, good, bad, taken) for _ in range(20_000))
    chi = cells = 0
    for k in range(max(0, taken - bad), min(good, taken) + 1):
        expected = 20_000 * comb(good, k) * comb(bad, taken - k) / comb(good + bad, taken)
        if expected >= 5:
            chi, cells = chi + (seen[k] - expected) ** 2 / expected, cells + 1
    assert chi < cells + 5 * (2 * cells) ** 0.5 + 5
    # beyond the range of numpy's sampler
    draws = [uniform_shards.hypergeometric(rng, 3 * 10**9, 6 * 10**9, 3 * 10**9) for _ in range(400)]
    assert abs(np.mean(draws) - 10**9) < 5 * 21_082 / 20 and 15_000 < np.std(draws) < 27_000


def test_shards_hold_every_row_once(spark, docs_of, edges):
    pairs = [(i, f"text {i % 7}") for i in range(500)] + edges
    rows = uniform_shards.sharded(docs_of(pairs).repartition(7), shards=5, block_rows=20).collect()
    assert Counter((r["doc_id"], r["text"]) for r in rows) == Counter(pairs)
    sizes = Counter(r["shard"] for r in rows)
    assert sum(sizes.values()) == len(pairs) and max(sizes.values()) - min(sizes.values()) <= 1 and len(sizes) == 5
    for shard, n in sizes.items():
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(n))


def test_shards_are_uniform_over_places(spark):
    hits = Counter()
    base = spark.range(0, 40, 1, 4)
    for seed in range(25):
        for r in uniform_shards.sharded(base, shards=2, seed=seed, block_rows=7).filter("id < 4").collect():
            hits[(r["shard"], r["slot"] // 5)] += 1
    assert sum(hits.values()) == 100
    assert sum((hits[(s, b)] - 12.5) ** 2 / 12.5 for s in range(2) for b in range(4)) < 24.3


def test_shards_of_few_rows_and_clashing_names(spark, docs_of, clashing, tmp_path):
    assert uniform_shards.sharded(docs_of([]), shards=3).collect() == []
    assert [(r["shard"], r["slot"]) for r in uniform_shards.sharded(docs_of([(1, "a")]), shards=3).collect()] == [(0, 0)]
    own = clashing([(1, "a"), (2, "b"), (None, None)]).withColumnsRenamed({"score": "part", "n_words": "slot"})
    out = uniform_shards.sharded(own, shards=2)
    assert out.columns == ["doc_id", "text", "part", "a.b", "source", "shard", "slot"]
    assert sorted(str(r["part"]) for r in out.collect()) == ["own"] * 3
    uniform_shards.write_shards(out, str(tmp_path / "shards"))
    assert spark.read.parquet(str(tmp_path / "shards")).count() == 3


# ---------------------------------------------------------------- op12


def plain_collocations(rows, min_count, top):
    """The definition, with exact integers and no streams."""
    grams, totals = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lowered):
            words = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    own = grams.setdefault(lang, Counter())
                    own[tuple(words[i : i + k])] += 1
    out = []
    for lang, counts in grams.items():
        candidates = {p: c for p, c in counts.items() if len(p) > 1 and c >= min_count}
        found = []
        for p, a in candidates.items():
            covered = any(
                len(q) > len(p) and 100 * c >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
                for q, c in candidates.items()
            )
            if not covered:
                score, _, left, right = min(
                    (2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p))
                )
                found.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], start=1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


@pytest.mark.parametrize("top", [5, 2000])
def test_collocations_equal_the_definition(spark, top):
    rng = random.Random(top)
    rows = []
    for i in range(160):
        lang = rng.choice(["en", "fr", None, "a\tb c+%", ""])
        words = [rng.choice(["The", "the", "of", "new", "york", "CITY", "été", "x\x01", "the\x01"]) for _ in range(rng.randrange(60))]
        text = "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "!"]) for w in words)
        rows.append((i, rng.choice([text, text, text, None, ""]), lang))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    found = sorted(tuple(r) for r in collocations.collocations(docs, top=top, min_count=6).collect())
    assert found == plain_collocations([(lang, text) for _, text, lang in rows], 6, top)
    assert found


def test_collocations_keep_partial_sums_at_every_border():
    """Cut anywhere, the sorted stream gives the same sums."""
    rng = random.Random(2)
    texts = [" ".join(rng.choice("ab") for _ in range(12)) + "." for _ in range(20)]
    keys, counts = collocations.window_counts(pa.array(texts), ["en"] * 20)
    order = np.argsort(np.array([k.encode() for k in keys.to_pylist()], object))
    keys, counts = keys.take(pa.array(order)), counts[order]
    whole = dict.fromkeys([])
    for size in (1, 3, 7, len(keys)):
        sums = Counter()
        for at in range(0, len(keys), size):
            for phrase, k, c in collocations.phrase_counts(keys.slice(at, size), counts[at : at + size], 10):
                sums[(phrase, k)] += c
        kept = {p: c for p, c in sums.items() if c >= 10}
        whole = whole or kept
        assert kept == whole
    assert max(k for _, k in whole) == 4


def test_scores_do_not_leave_64_bits(spark):
    expr = "(2000000 * CAST(a AS DECIMAL(20, 0))) div (CAST(a AS DECIMAL(20, 0)) + CAST(b AS DECIMAL(20, 0)))"
    a, b = 9_000_000_000_000_000_000, 9_100_000_000_000_000_001
    row = spark.createDataFrame([(a, b)], "a long, b long").selectExpr(f"{expr} AS s").first()
    assert row["s"] == 2_000_000 * a // (a + b)


def test_collocations_of_nothing_and_of_clashing_names(spark, docs_of, clashing):
    assert collocations.collocations(docs_of([])).collect() == []
    assert collocations.collocations(docs_of([(1, None), (2, ""), (3, "one word. two")]), min_count=2).collect() == []
    own = clashing([(1, "big cat"), (2, "Big cat"), (None, "big\tcat")]).withColumnsRenamed({"score": "lang", "source": "key"})
    assert [tuple(r) for r in collocations.collocations(own, min_count=3).collect()] == [("own", 1, "big cat", 3, 3, 3, 6, 1_000_000)]


def test_hot_windows_leave_a_task_whole(spark, docs_of, monkeypatch):
    monkeypatch.setattr(collocations, "_WAITING", 2)
    docs = docs_of([(i, "same words here again " * 40) for i in range(50)])
    found = {r["phrase"]: r["a"] for r in collocations.scored(docs).collect()}
    assert found["same words here again"] == 2000


# ---------------------------------------------------------------- op13


def plain_runs(words, min_words=24, min_periods=3):
    n, out = len(words), []
    for d in range(1, n // min_periods + 1):
        i = 0
        while i + d < n:
            if words[i] != words[i + d]:
                i += 1
                continue
            begin = i
            while i + d < n and words[i] == words[i + d]:
                i += 1
            length = i + d - begin
            own = words[begin : begin + length]
            if length >= max(min_words, min_periods * d) and all(own[q:] != own[:-q] for q in range(1, d)):
                out.append((begin, length, d))
    return sorted(out, key=lambda r: (r[0], r[2]))


def random_words(rng):
    k, wanted, words = rng.choice([1, 2, 3, 5, 30]), rng.choice([0, 30, 90, 200]), []
    while len(words) < wanted:
        if words and rng.random() < 0.4:
            p = rng.randrange(1, min(len(words), 30) + 1)
            words += (words[-p:] * 5)[: rng.randrange(1, 4 * p + 1)]
        else:
            words += [rng.randrange(k) for _ in range(rng.randrange(8))]
    return words


def test_runs_equal_brute_force_with_and_without_the_screen():
    rng = random.Random(7)
    texts, expected = [], []
    for _ in range(300):
        words = random_words(rng)
        texts.append(" ".join(f"w{x}" for x in words))
        expected.append(plain_runs(words))
        assert periodic_runs.repetitions(words) == expected[-1]
        assert periodic_runs.repetitions(words, 6, 3) == plain_runs(words, 6, 3)
    for screen in (True, False):
        assert [f.runs for f in periodic_runs.search(pa.array(texts), screen)] == expected
    assert sum(map(len, expected)) > 200


def test_long_periodic_words_take_linear_space_and_time():
    for words, run in ([[0] * 30_000, (0, 30_000, 1)], [[i % 7000 for i in range(30_000)], (0, 30_000, 7000)]):
        assert periodic_runs.repetitions(words) == [run]


def changed(doc_id, text):
    """The contract's rule for the given words of a document."""
    words = WORDS.findall(text or "")
    n = len(words)
    h = crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    return words


def expected_row(doc_id, text):
    from hashlib import sha256

    words = changed(doc_id, text)
    runs = plain_runs(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    one = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *one, sha256(lines.encode()).hexdigest(), sha256(kept.encode()).hexdigest())


def test_query_on_planted_periods(spark, docs_of, edges, tmp_path):
    rng = random.Random(11)
    pairs = [(i, rng.choice(["\n", " ", "  "]).join(f"w{x}" for x in random_words(rng))) for i in range(150)]
    pairs += [(i, "lone") for i in range(200, 230)] + [e for e in edges if len(e[1] or "") < 1000]
    docs_of(pairs).write.parquet(str(tmp_path / "documents.parquet"))
    found = queries.op13_automaton_runs(spark, str(tmp_path)).collect()
    key = lambda r: tuple((v is None, v) for v in r)
    assert sorted(map(tuple, found), key=key) == sorted((expected_row(*p) for p in pairs), key=key)


def test_runs_of_nothing_of_long_texts_and_of_clashing_names(docs_of, clashing, edges):
    assert periodic_runs.with_runs(docs_of([])).collect() == []
    rows = {(r["doc_id"], r["n_words"]): r for r in periodic_runs.with_runs(docs_of(edges)).collect()}
    long = rows[(4, 60_000)]
    assert [tuple(r) for r in long["runs"]] == [(0, 60_000, 3)] and long["collapsed"] == "word other third"
    assert rows[(1, 0)]["runs"] == [] and rows[(1, 0)]["collapsed"] == ""
    own = clashing([(1, "a b " * 20), (None, None)]).withColumnRenamed("score", "runs")
    assert sorted(len(r["runs"]) for r in periodic_runs.with_runs(own).collect()) == [0, 1]
