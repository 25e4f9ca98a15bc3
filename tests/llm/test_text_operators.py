"""Toxicity, near duplicates, decontamination, surrogates, pieces and quality on small fixtures."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from ratingml.llm import fm_decontam, minhash_forest, pii_surrogates, quality_hosts, toxicity_fm, unigram_pieces

WORDS = [f"w{i}" for i in range(400)]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


# -- toxicity


def pair_texts(n, seed):
    """Toxic only where an insult and a group stand together."""
    rng = random.Random(seed)
    texts, labels = [], []
    for _ in range(n):
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        words = rng.sample(WORDS, 12) + ["vermin"] * insult + ["neighbours"] * group
        rng.shuffle(words)
        texts.append(" ".join(words))
        labels.append(int(insult and group))
    return texts, np.array(labels, float)


def test_pairs_of_terms_are_learned():
    texts, labels = pair_texts(1500, 1)
    known = toxicity_fm._Remembered()
    model = toxicity_fm.learn([toxicity_fm._set_of(t, known) for t in texts], labels)
    row_of = np.full(toxicity_fm.BUCKETS, -1, np.int32)
    row_of[model.buckets] = np.arange(len(model.buckets))
    known = toxicity_fm._Remembered(row_of)
    new, truth = pair_texts(400, 2)
    scores = np.array([toxicity_fm.score_set(toxicity_fm._set_of(t, known), model) for t in new])
    assert scores[truth == 1].min() > scores[truth == 0].max()


def learned_scores(texts, labels, new):
    known = toxicity_fm._Remembered()
    model = toxicity_fm.learn([toxicity_fm._set_of(t, known) for t in texts], np.array(labels, float))
    row_of = np.full(toxicity_fm.BUCKETS, -1, np.int32)
    row_of[model.buckets] = np.arange(len(model.buckets))
    known = toxicity_fm._Remembered(row_of)
    return np.array([toxicity_fm.score_set(toxicity_fm._set_of(t, known), model) for t in new])


@pytest.mark.parametrize("one", [True, False])
def test_pairs_count_where_no_single_term_does(one):
    """Toxic with exactly one of two words, or with both or neither: each word alone is at chance."""

    def table(n, seed):
        rng = random.Random(seed)
        marks = [(rng.random() < 0.5, rng.random() < 0.5) for _ in range(n)]
        texts = [" ".join(rng.sample(WORDS, 12) + ["vermin"] * a + ["neighbours"] * b) for a, b in marks]
        return texts, np.array([(a != b) == one for a, b in marks], float)

    new, truth = table(400, 2)
    scores = learned_scores(*table(1500, 1), new)
    assert ((scores >= 0.5) == (truth == 1)).mean() > 0.97


def test_many_rare_insults_at_a_balanced_share():
    """60 insults in about 10 texts each, all of them toxic."""

    def table(n, seed):
        rng = random.Random(seed)
        return [" ".join(rng.sample(WORDS, 12) + [f"insult{rng.randrange(60)}"] * (i % 2)) for i in range(n)]

    truth = np.arange(400) % 2
    scores = learned_scores(table(1200, 1), np.arange(1200) % 2, table(400, 2))
    assert scores[truth == 1].min() > scores[truth == 0].max()


def test_score_is_the_formula():
    model = toxicity_fm.Model(-0.5, np.array([3, 7]), np.array([0.2, -0.1]), np.array([[0.3, 0.1], [0.2, -0.4]]))
    z = -0.5 + 0.2 - 0.1 + (0.3 * 0.2 + 0.1 * -0.4)
    assert toxicity_fm.score_set(np.array([0, 1]), model) == pytest.approx(1 / (1 + np.exp(-z)))


def test_held_out_labels_are_not_read(spark, docs_of):
    texts, labels = pair_texts(900, 3)
    docs = docs_of(list(enumerate(texts)))
    held = [zlib.crc32(str(i).encode()) % 3 == 1 for i in range(900)]
    rows = [(i, int(labels[i]), int(labels[i])) for i in range(900)]
    turned = [(i, 1, int(1 - y) if h else int(y)) for (i, _, y), h in zip(rows, held)]
    one = toxicity_fm.fit(docs, spark.createDataFrame(rows, "doc_id long, quality int, toxic int"))
    two = toxicity_fm.fit(docs, spark.createDataFrame(turned, "doc_id long, quality int, toxic int"))
    assert one.bias == two.bias and np.array_equal(one.weights, two.weights)
    scored = toxicity_fm.scored(docs, one).toPandas().sort_values("doc_id")
    out = np.array(held)
    assert ((scored["score"].to_numpy() >= 0.5) == (labels == 1))[out].mean() > 0.97


def test_toxicity_edges(spark, edges, clashing):
    model = toxicity_fm.fit(clashing(edges), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    found = toxicity_fm.scored(clashing(edges), model, score_col="tox").collect()
    assert len(found) == len(edges) and {round(r["tox"], 3) for r in found} == {0.269}
    assert toxicity_fm.scored(clashing(edges).limit(0), model, score_col="tox").count() == 0


# -- near duplicates


def brute(texts, words=5, threshold=0.8):
    known = minhash_forest._Hashes()
    sets = [frozenset(minhash_forest.shingles(t, known, words).tolist()) for t in texts]
    links = [
        [j for j in range(len(sets)) if j != i and sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j])]
        for i in range(len(sets))
    ]
    return links


def near_copies(rng, n_groups, size):
    texts = []
    for _ in range(n_groups):
        base = prose(rng, 120).split()
        for _ in range(size):
            own = list(base)
            for _ in range(rng.randrange(0, 4)):
                own[rng.randrange(len(own))] = "changed" + str(rng.randrange(10**6))
            texts.append(" ".join(own))
    return texts


def roots_of(links):
    root = list(range(len(links)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, own in enumerate(links):
        for j in own:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(links))]


@pytest.mark.parametrize("block", [512, 7])
def test_links_equal_brute_force(docs_of, monkeypatch, block):
    rng = random.Random(4)
    texts = near_copies(rng, 6, 12) + [prose(rng, 100) for _ in range(30)] + ["a b c", "a b c", "a b", "", None]
    monkeypatch.setattr(minhash_forest, "BLOCK", block)
    found = {r["doc_id"]: r for r in minhash_forest.joined(docs_of(list(enumerate(texts)))).collect()}
    links = brute(texts)
    roots = roots_of(links)
    linked = [i for i in range(len(texts)) if links[i]]
    assert len(linked) > 40
    same = sum(found[i]["n_links"] == len(links[i]) for i in range(len(texts)))
    assert same >= 0.99 * len(texts)
    assert all(found[i]["class_id"] == roots[i] for i in range(len(texts)))


def test_kept_is_one_of_each_group(docs_of, edges):
    rng = random.Random(5)
    texts = near_copies(rng, 3, 5)
    pairs = list(enumerate(texts, 100)) + edges
    kept = minhash_forest.deduplicated(docs_of(pairs)).collect()
    ids = [r["doc_id"] for r in kept]
    assert [i for i in ids if i and i >= 100] and len([i for i in ids if i and i >= 100]) == len(set(roots_of(brute(texts))))
    assert sorted(i for i in ids if i and i < 100) == [1, 2, 4, 5, 6] and None in ids


def test_prefix_is_shortened_until_the_recall():
    depth = minhash_forest.prefix_length(0.8)
    assert depth == 4 and 1 - (1 - 0.8**depth) ** minhash_forest.TREES >= minhash_forest.TARGET_RECALL
    assert minhash_forest.prefix_length(0.99) > depth


def _connected(n, pairs):
    label = list(range(n))
    for a, b in pairs:
        old, new = label[a], label[b]
        label = [new if x == old else x for x in label]
    return {frozenset(i for i in range(n) if label[i] == x) for x in label}


@pytest.mark.parametrize("batch", [1, 100_000])
@pytest.mark.parametrize("crossing", [False, True])
def test_descent_of_the_tries_connects_what_all_pairs_connect(batch, crossing):
    rng = np.random.default_rng(7)
    for _ in range(60):
        n = int(rng.integers(1, 90))
        unit = np.sort(rng.integers(0, 3, n))
        labels = rng.integers(0, 2, (n, minhash_forest.DEPTH)).astype("<u2")
        order, shared = minhash_forest.sorted_trie(unit, labels)
        unit, labels = unit[order], labels[order]
        assert [tuple(r) for r in labels[unit == unit[0]].tolist()] == sorted(map(tuple, labels[unit == unit[0]].tolist()))
        sides = rng.integers(0, 2, n) if crossing else np.full(n, -1)
        alike = rng.random((n, n)) < 0.1
        alike |= alike.T
        asked = []

        def agree(a, b):
            asked.extend(zip(a.tolist(), b.tolist()))
            return alike[a, b]

        a, b = minhash_forest.descend(shared, sides, 4, agree, batch)
        every = [
            (i, j)
            for i in range(n)
            for j in range(i + 1, n)
            if unit[i] == unit[j] and (labels[i, :4] == labels[j, :4]).all() and (not crossing or sides[i] != sides[j])
        ]
        assert len(asked) == len(set(asked)) and set(asked) <= set(every)
        assert _connected(n, zip(a.tolist(), b.tolist())) == _connected(n, [p for p in every if alike[p]])


def test_full_depth_comes_first_and_connected_labels_stay_apart():
    """Four equal labels and one that differs in its last value: six pairs at most are asked, and the last one once."""
    labels = np.array([[1] * 8] * 4 + [[1] * 7 + [2]], "<u2")
    order, shared = minhash_forest.sorted_trie(np.zeros(5, int), labels)
    asked = []

    def agree(a, b):
        asked.append((order[a].tolist(), order[b].tolist()))
        return np.ones(len(a), bool)

    minhash_forest.descend(shared, np.full(5, -1), 4, agree)
    assert [len(a) for a, _ in asked] == [6, 4]


def test_recall_of_pairs_next_to_the_threshold(spark, docs_of):
    """Pairs of a similarity from 0.80 to 0.85 by brute force: at least 0.99 of them are linked."""
    rng = random.Random(12)
    texts = []
    for _ in range(150):
        own = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        other = list(own)
        for at in rng.sample(range(0, 200, 8), 4):
            other[at] = f"x{rng.randrange(10**6)}"
        texts += [" ".join(own), " ".join(other)]
    near = [
        i
        for i in range(0, len(texts), 2)
        if 0.8 <= (lambda a, b: len(a & b) / len(a | b))(*({tuple(t.split()[j : j + 5]) for j in range(196)} for t in texts[i : i + 2])) <= 0.85
    ]
    assert len(near) > 100
    found = {r["doc_id"]: r["class_id"] for r in minhash_forest.joined(docs_of(list(enumerate(texts)))).collect()}
    assert sum(found[i] == found[i + 1] for i in near) >= 0.99 * len(near)


def test_components_are_the_connected_ones(spark):
    rng = random.Random(6)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1040)] + [(7, 7)]
    links = [[] for _ in range(1100)]
    for a, b in pairs:
        links[a].append(b)
        links[b].append(a)
    roots = roots_of(links)
    found = {r["node"]: r["root"] for r in minhash_forest.components(spark.createDataFrame(pairs, "a long, b long"), "test").collect()}
    assert found == {i: roots[i] for i in range(1100) if any(j != i for j in links[i])}


def test_join_of_an_empty_table(docs_of):
    assert minhash_forest.joined(docs_of([])).count() == 0


# -- decontamination


def brute_hits(text, items):
    words = fm_decontam.words_of(text)
    hit, found = set(), set()
    for name, item in items:
        own = fm_decontam.words_of(item)
        n = min(len(own), 10)
        for s in range(max(1, len(own) - 9) if own else 0):
            for i in range(len(words) - n + 1):
                if words[i : i + n] == own[s : s + n]:
                    hit |= set(range(i, i + n))
                    found.add(str(name))
    return len(words), len(hit), sorted(found)


def test_index_finds_what_brute_force_finds():
    rng = random.Random(7)
    items = [(i, prose(rng, rng.choice([0, 1, 3, 10, 11, 40]))) for i in range(25)] + [(99, "É x"), (98, None)]
    texts = []
    for _ in range(40):
        words = prose(rng, rng.randrange(0, 60))
        item = rng.choice(items)[1] or ""
        cut = item.split()[rng.randrange(0, 5) :]
        texts.append((words + "! " + " ".join(cut) + ". " + prose(rng, 5)).strip())
    texts += [None, "", items[5][1], items[5][1], "é É x, É.X", "İ no"]
    phrases = fm_decontam.phrases_of(items)
    for limit in (fm_decontam.SHARD_WORDS, 20):
        hits = fm_decontam.search_texts(texts, phrases, limit)
        for text, hit in zip(texts, hits):
            got = (hit.n_words, sum(e - s for s, e in hit.spans), sorted(phrases.items[i] for i in hit.items))
            assert got == brute_hits(text, items)


def test_suffix_order_is_sorted():
    rng = np.random.default_rng(8)
    for top in (2, 3, 50):
        symbols = np.append(np.concatenate([rng.integers(1, top, 200), np.ones(40, int), rng.integers(1, top, 60)] * 2), 0)
        order = fm_decontam.suffix_order(symbols)
        assert order.tolist() == sorted(range(len(symbols)), key=lambda i: symbols[i:].tolist())


def test_locate_gives_every_place():
    rng = np.random.default_rng(9)
    symbols = np.append(rng.integers(1, 4, 500), 0)
    index = fm_decontam.FMIndex(symbols)
    windows = np.zeros((1, 10), np.int64)
    windows[0, -2:] = [2, 3]
    found, low, high = index.search(windows, np.array([2]))
    places = sorted(index.locate(np.arange(low[0], high[0])).tolist())
    assert places == [i for i in range(500) if symbols[i : i + 2].tolist() == [2, 3]]


def test_spans_are_cut_until_none_is_left(spark, docs_of, edges):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    bench = spark.createDataFrame([(1, item), (2, "one two"), (3, None), (None, "null item")], "item_id long, text string")
    texts = [f"Start, {item.upper()}; end.", item, "one (one two) two", "clean text stays"] + [t for _, t in edges]
    done = fm_decontam.without_passages(docs_of(list(enumerate(texts))), bench).orderBy("doc_id").collect()
    assert [r["text"] for r in done[:4]] == ["Start,\n; end.", "", "", "clean text stays"]
    assert [r["text"] for r in done[4:]] == [t for _, t in edges]
    assert all(r["n_chars"] == len(r["text"]) for r in done if r["text"] is not None)
    nothing = fm_decontam.matched(docs_of(edges), bench.limit(0)).collect()
    assert all(r["n_hit"] == 0 and r["items"] == [] for r in nothing)


# -- personal data

PRIVATE = [
    (1, "Mr. John Smith wrote to Mrs. Smith; Mr. JOHN SMITH called +1 (407) 555-7710."),
    (2, "mail Ann.B@mail4.example.com or ann.b@mail4.example.com, x.01@mail4.example.com"),
    (3, "card 4111111111111111 or 4111 1111 1111 1111, host 106.158.249.239, ssn 123-45-6789"),
    (4, 'token = "186661156f3f9905942d70850a01cbf23a203f82" г-жа Анна Петрова'),
    (5, "call +1 (407) 555-7710, version 1.2.3 on 2024-01-02 of 10 pages"),
]


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def test_surrogates_keep_kind_form_and_identity(docs_of, edges):
    docs = docs_of(PRIVATE + [(10 + (i or 0), t) for i, t in edges])
    done = {r["doc_id"]: r["text"] for r in pii_surrogates.replaced(docs, "k").collect()}
    for secret in ("John", "Smith", "SMITH", "407", "555-7710", "mail4", "Ann.B", "4111111111111111", "106.158", "123-45", "18666", "Анна", "Петров"):
        assert not any(secret in t for t in done.values() if t)
    one = re.fullmatch(r"Mr\. (\w+) (\w+) wrote to Mrs\. (\w+); Mr\. (\w+) (\w+) called (\+1 \(\d{3}\) \d{3}-\d{4})\.", done[1])
    assert one and one[2] == one[3] and (one[4], one[5]) == (one[1].upper(), one[2].upper()) and one[1].endswith("n")
    assert one[6] in done[5] and "version 1.2.3 on 2024-01-02 of 10 pages" in done[5]
    two = re.fullmatch(r"mail (\w{3}\.\w@\w{5}\.\w{7}\.com) or (\S+), (\w\.\d\d@(\S+))", done[2])
    assert two and two[1] != two[2] and two[1].lower() == two[2] and two[2].endswith("@" + two[4])
    three = re.fullmatch(r"card (\d{16}) or ([\d ]{19}), host (\d{3}\.\d{3}\.\d{3}\.\d{3}), ssn \d{3}-\d\d-\d{4}", done[3])
    assert three and three[2].replace(" ", "") == three[1] and luhn(three[1]) and three[1][0] == "4"
    assert max(map(int, three[3].split("."))) <= 255
    assert re.fullmatch(r'token = "[0-9a-f]{40}" г-жа [А-Я][а-я]+на [А-Я][а-я]+рова', done[4])
    assert [done[10 + (i or 0)] for i, _ in edges if i not in (5,)] == [t for i, t in edges if i not in (5,)]


ADJACENT = [
    "Ann.B@mail4.example.com", "12@x.com", "106.158.249.239", "186661156f3f9905942d70850a01cbf23a203f82", "4111 1111 1111 1111",
    "4111111111111111", "123-45-6789", "+1 (826) 555-4081", "+44 20 7946 0958", "(407) 555-7710", "407-555-7710", "Mr. John Smith", "Mrs. Smith",
]


def test_adjacent_entities_are_found_apart(spark):
    rows = [(f"see {a}{gap}{b}.", a, b) for a in ADJACENT for b in ADJACENT for gap in (" ", ", ", "\n")]
    found = spark.createDataFrame(rows, "text string, a string, b string").withColumn("found", pii_surrogates.entities(F.col("text")))
    assert [(r["text"], r["found"]) for r in found.collect() if r["found"] != [r["a"], r["b"]]] == []


def test_phone_before_an_address_keeps_its_surrogate(docs_of):
    docs = docs_of([(1, "+1 (826) 555-4081 190.137.223.204"), (2, "+1 (826) 555-4081"), (3, "190.137.223.204")])
    done = {r["doc_id"]: r["text"] for r in pii_surrogates.replaced(docs, "k").collect()}
    assert done[1] == f"{done[2]} {done[3]}" and "204" not in done[1]
    long = docs_of([(1, "+39 06 12.34.56.78"), (2, "+12345678901234567890")]).select(pii_surrogates.entities(F.col("text")).alias("f"))
    assert sorted(r["f"] for r in long.collect()) == [[], ["+39 06 12.34.56.78"]]


def test_a_wider_surrogate_is_written_whole(spark):
    raw = spark.createDataFrame(
        [("123-45-6789", "ssn", "9876543210"), ("1.2.3.4", "ip", "100.101.102.103"), ("A@x.org", "email", "bcd@y.org")],
        "raw string, kind string, surrogate string",
    )
    written = raw.select(pii_surrogates.written_as(F.col("raw"), F.col("kind"), F.col("surrogate")).alias("w"))
    assert [r["w"] for r in written.collect()] == ["987-65-43210", "100.101.102.103", "Bcd@y.org"]


def test_a_crowded_form_gets_distinct_surrogates_in_texts(docs_of):
    quads = [f"{a}.{b}.{c}.{d}" for a in range(1, 10) for b in range(1, 10) for c in range(1, 10) for d in range(1, 6)]
    done = [r["text"] for r in pii_surrogates.replaced(docs_of([(i, f"see {q} now") for i, q in enumerate(quads)]), "k").collect()]
    found = [t.split()[1] for t in done]
    assert len(set(found)) == len(quads) == 3645 and not set(found) & set(quads)


def test_colliding_surrogates_are_drawn_again(spark):
    # 63 of the 81 surrogates of their form are real themselves, so most have to become wider
    small = spark.createDataFrame([("ip", f"{a}.{b}") for a in range(1, 10) for b in range(1, 8)], "kind string, canonical string")
    wide = spark.createDataFrame([("ip", f"{a}.{b}.9.9") for a in range(10, 40) for b in range(10, 40)], "kind string, canonical string")
    letters = spark.createDataFrame([("email", f"{c}@mail.org") for c in "abcdefghijklmnopqrstuvwxyz"], "kind string, canonical string")
    secret = spark.createDataFrame([("ssn", f"{i:01d}") for i in range(10)], "kind string, canonical string")
    for rows in (wide, small, letters, secret):
        done = pii_surrogates.assigned(rows, "k").collect()
        new, real = [r["surrogate"] for r in done], {r["canonical"] for r in done}
        assert len(done) == rows.count() == len(set(new)) and not real & set(new)


def test_texts_without_entities_pass(clashing):
    docs = clashing([(1, "plain"), (2, None), (3, "")])
    assert pii_surrogates.replaced(docs, "k").columns == docs.columns
    assert sorted(map(str, pii_surrogates.replaced(docs, "k").collect())) == sorted(map(str, docs.collect()))
    assert pii_surrogates.replaced(docs.limit(0), "k").count() == 0


# -- pieces


@pytest.fixture(scope="module")
def vocab():
    return unigram_pieces.load(public_tokenizers.path("piece_bpe_32k.model"))


def best_path(text, vocab):
    """Plain recursion over characters: score and ids."""
    words = {p.decode(): i for i, p in enumerate(vocab.pieces) if i >= vocab.first_byte + 256 and p}
    mark = unigram_pieces.MARKER
    chars = [(None, mark)] + [(mark, mark) if c == mark else (c, mark if c == " " else c) for c in text] if text else []
    best, back = [0.0] + [-1e300] * len(chars), [None] * (len(chars) + 1)
    for i in range(len(chars)):
        piece = ""
        for j in range(i, min(len(chars), i + 20)):
            if chars[j][0] == mark:
                break
            piece += chars[j][1]
            if piece in words and best[i] + vocab.scores[words[piece]] > best[j + 1]:
                best[j + 1], back[j + 1] = best[i] + vocab.scores[words[piece]], (i, [words[piece]])
        if best[i] + vocab.fallback > best[i + 1]:
            best[i + 1], back[i + 1] = best[i] + vocab.fallback, (i, [vocab.first_byte + b for b in chars[i][1].encode()])
    ids, at = [], len(chars)
    while at:
        at, own = back[at]
        ids = own + ids
    return ids


TEXTS = ["", " ", "  a", "a  b ", "x▁y ▁ z", "日本語テキスト🎉", "a" * 700, "\n\n a", "abc" * 200 + " " + "▁" * 5, "\x00 é", "The heart of the matter."]


def test_pieces_are_the_best_path(vocab):
    coder = unigram_pieces.Encoder(vocab)
    ids, counts = coder.encode(TEXTS)
    ends = np.cumsum(counts)
    for text, end, n in zip(TEXTS, ends, counts):
        assert ids[end - n : end].tolist() == best_path(text, vocab)
    assert coder.decode(ids, counts) == TEXTS


def test_double_array_holds_exactly_the_words():
    rng = random.Random(10)
    words = {bytes(rng.choice(b"ab\xe2\x96c") for _ in range(rng.randrange(1, 7))): i for i in range(300)}
    base, check, value = unigram_pieces.double_array(words)
    for word in [*words, *(w + b"a" for w in words), *(w[:-1] for w in words)]:
        node, ok = 0, True
        for c in word:
            child = base[node] + c
            ok = ok and base[node] > 0 and check[child] == node
            node = child if ok else 0
        assert (value[node] if ok and word else -1) == words.get(word, -1)


def test_encoded_rows(vocab, docs_of, edges):
    found = unigram_pieces.encoded(docs_of(edges), vocab).collect()
    assert len(found) == len(edges) and all(r["round_trip"] for r in found)
    assert {(r["text"] is None, r["ids"] is None) for r in found} == {(True, True), (False, False)}


# -- quality


def test_repeats_and_lines_by_brute_force(docs_of):
    rng = random.Random(11)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randrange(0, 40))) + "\n" * rng.randrange(3) + "x y\nx y" for _ in range(40)]
    texts += ["\x0ba\x0cb", "é# $a", None, ""]
    found = {r["doc_id"]: r for r in quality_hosts.measures(docs_of(list(enumerate(texts))).select("doc_id", "text")).collect()}
    for i, text in enumerate(texts):
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
        windows = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
        covered = {k + d for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for d in range(3)}
        lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        row = found[i]
        assert (row["n_words"], row["word_chars"]) == (len(words), sum(map(len, words)))
        assert (row["n_repeat_words"], row["n_dup_lines"]) == (len(covered), len(lines) - len(set(lines)))
        assert row["n_symbols"] == len(re.findall(r"[#*$%&|<>]", text or ""))


def test_small_hosts_are_shrunk(docs_of):
    good = " ".join(WORDS[:80])
    pairs = [(i, "bad") for i in range(100)] + [(i, good) for i in range(100, 300)] + [(300, "bad"), (301, good)]
    host = lambda i: "spam" if i < 95 else "tiny" if i >= 300 else f"h{i % 4}"
    found = {r["doc_id"]: r for r in quality_hosts.judge(docs_of(pairs, host)).collect()}
    assert not found[96]["kept"] and found[150]["kept"] and found[301]["kept"]
    assert found[0]["host_rate"] > 0.9 and 0 < found[301]["host_rate"] < 0.6
    assert quality_hosts.judge(docs_of([])).count() == 0


def test_prior_follows_the_spread():
    assert quality_hosts.prior(1, 10, 5, 100.0, 2.5) == (0.0, 0.0)
    same = quality_hosts.prior(10, 1000, 500, 1e5, 250.0)
    assert sum(same) == 1e6
    apart = quality_hosts.prior(2, 200, 100, 2e4, 60.0)
    assert 1 < sum(apart) < 2


def test_quality_edges(edges, clashing):
    found = quality_hosts.judge(clashing(edges)).collect()
    assert len(found) == len(edges) and not any(r["kept"] for r in found if r["doc_id"] in (1, 2, 6))


def test_model_bound_is_a_parameter(spark, docs_of):
    texts, labels = pair_texts(300, 12)
    rows = spark.createDataFrame([(i, 1, int(y)) for i, y in enumerate(labels)], "doc_id long, quality int, toxic int")
    few = toxicity_fm.fit(docs_of(list(enumerate(texts))), rows.withColumn("toxic", F.col("toxic")), max_rows=3)
    assert len(few.buckets) == 0


def test_toxicity_model_does_not_depend_on_the_order_of_rows_or_on_repeated_ids(spark, docs_of):
    pairs = [(i, f"word{i % 7} other{i % 5} " + ("vile slur" if i % 3 == 0 else "kind note")) for i in range(240)]
    pairs += [(i, f"another text {i}") for i in range(0, 240, 4)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(240)], "doc_id long, toxic int")
    a, b = (toxicity_fm.fit(docs_of(rows).repartition(n), labels) for rows, n in ((pairs, 1), (pairs[::-1], 5)))
    assert a.bias == b.bias and (a.buckets == b.buckets).all() and (a.weights == b.weights).all() and (a.factors == b.factors).all()


def test_near_copies_without_or_with_one_id_leave_one_document(docs_of):
    base = " ".join(f"w{i}" for i in range(100))
    pairs = [(None, base), (None, base + " end"), (None, base), (7, "alone here " * 9)]
    pairs += [(5, base.replace("w", "v")), (5, base.replace("w", "v") + " end")]
    left = [tuple(r) for r in minhash_forest.deduplicated(docs_of(pairs)).select("doc_id", "text").collect()]
    assert sorted((i is None, i) for i, _ in left) == [(False, 5), (False, 7), (True, None)]
