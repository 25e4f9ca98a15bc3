"""Main text, url verdicts, WARC archives and token files on small fixtures."""

import hashlib
import io
import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from ratingml.llm import html_mss, token_coder, url_filter, warc_normal

PAGE_SCHEMA = "page_id long, url string, html string"

# -- main text

PLAIN = html_mss.PLAIN


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""),
        ("", ""),
        ("<script>var a = '<p>no</p>'</script>", ""),
        ("<p>only", "only"),
        ("a &lt; b &amp;&#233; c", "a < b &é c"),
        ("<article><h1>T  x</h1><p>One\n two<br>three<p>four</article><footer>many words of no use here</footer>", "T x\n\nOne two three\n\nfour"),
        ("<nav><a href=/>Home</a> words words</nav><div><p>real text here</p><div class='ad-box'>buy <div>now</div></div><p>more text here</p></div>", "real text here\n\nmore text here"),
        ("<p>text of the page</p><div id=comments><p>a long reader comment that goes on</p></div>", "text of the page"),
        ("<div class='has-sidebar page'><p>text stays here</p></div>", "text stays here"),
        ("<p class=notice>we use cookies<p>text of the page</p>", "text of the page"),
        ("<p>one two <b>th</b>ree <a href='a>b'>four</a> five six</p>", "one two three four five six"),
        ("<!-- <p>no</p> --><p>yes yes", "yes yes"),
    ],
)
def test_main_text(page, text):
    assert html_mss.main_text(page, PLAIN) == text


def test_best_stretch_equals_brute_force():
    rng = random.Random(1)
    for _ in range(200):
        scores = [rng.randrange(-4, 4) for _ in range(rng.randrange(0, 9))]
        start, end = html_mss.best_stretch(scores)
        top = max([sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)], default=0)
        assert sum(scores[start:end]) == max(0, top)


def test_weights_keep_their_signs(spark):
    pages = ["<body><div>menu menu</div><article><p>word word word word</p></article></body>"] * 5 + ["no label"]
    found = html_mss.fit(spark.createDataFrame([(i, None, p) for i, p in enumerate(pages)], PAGE_SCHEMA))
    words = ("word", "told")
    assert all(found.by_key[k] > 0 for k in words) and all(w < 0 for k, w in found.by_key.items() if k not in words)
    rows = html_mss.extracted(spark.createDataFrame([(1, None, None), (1, None, pages[0])], PAGE_SCHEMA), found).collect()
    assert [r["text"] for r in rows] == ["", "word word word word"]
    assert html_mss.fit(spark.createDataFrame([], PAGE_SCHEMA)) == html_mss.PLAIN


TEACHING = "<body><div class=zug>{0} words of a frame</div><div class=page><article><p>{0} words of the text</p><ul><li>an item</ul></article></div></body>"
TAUGHT = "<body><div class=zug><p>seven words that frame a page here</p></div><div class=page><p>five words of the text</p></div></body>"


def test_unknown_class_is_learned(spark):
    """A class word that no list names is told by the labelled pages; its wrapper class stays content."""
    pages = [TEACHING.format(i) for i in range(30)]
    found = html_mss.fit(spark.createDataFrame([(i, None, p) for i, p in enumerate(pages)], PAGE_SCHEMA))
    assert found.elements[".zug"] < html_mss.BAD < 0 < found.elements[".page"]
    assert html_mss.main_text(TAUGHT, found) == "five words of the text"
    assert "frame" in html_mss.main_text(TAUGHT, html_mss.PLAIN)
    # items stand in content on these pages
    assert html_mss.main_text("<ul><li>one two three four</ul>", found) == "one two three four"


def test_listed_class_can_be_unlearned(spark):
    """A name that starts as no content becomes content where labelled pages wrap their article in it."""
    pages = [f"<div class=widget><article>{i} words of the text</article></div>" for i in range(200)]
    found = html_mss.fit(spark.createDataFrame([(i, None, p) for i, p in enumerate(pages)], PAGE_SCHEMA))
    page = "<div class=widget><p>five words of the text</p></div>"
    assert html_mss.main_text(page, found) == "five words of the text" and html_mss.main_text(page, html_mss.PLAIN) == ""


def test_scan_settles_what_no_name_tells():
    """All that names leave is more than the stretch that the scan finds."""
    links = "".join(f"<li><a href=/{i}>place {i}</a></li>" for i in range(8))
    page = f"<ul>{links}</ul><p>a text of some eight words or more</p><p>and one more</p><ul>{links}</ul>"
    assert html_mss.main_text(page, html_mss.PLAIN) == "a text of some eight words or more\n\nand one more"
    left = [p.text for p in html_mss.parts_of(page, html_mss.PLAIN) if p.text.strip()]
    assert len(left) == 18


def test_inside_of_an_article():
    page = "<article><h1>Two words</h1><div class=ad>buy this now at once</div><p>text</p><div id=comments><article>not mine</article></div></article>"
    teach = html_mss.weights_from(html_mss.counts_of([f"<nav>{i} menu</nav><div class=ad>buy</div><article><p>{i} words</p></article>" for i in range(50)]))
    for weights in (html_mss.PLAIN, teach):
        assert html_mss.main_text(page, weights) == "Two words\n\ntext"


def test_bound_is_on_labelled_pages(spark):
    """Pages without a label never use up the bound; an id with several pages counts once; row order changes nothing."""
    plain = [(i, None, "<p>no label here") for i in range(400)]
    told = [(1000 + i, None, TEACHING.format(i)) for i in range(6)]
    again = [(1000, None, TEACHING.format("other")), (None, None, TEACHING.format("null id"))] + told[:2]
    rows = plain + told + again
    found = html_mss.fit(spark.createDataFrame(rows, PAGE_SCHEMA), max_pages=6)
    assert found.elements[".zug"] == pytest.approx(np.log(0.5 / 6.5))
    assert html_mss.fit(spark.createDataFrame(rows[::-1], PAGE_SCHEMA).repartition(7), max_pages=6) == found


def test_clashing_columns_of_pages(spark):
    rows = spark.createDataFrame([(1, "<p>one", "x", "y", "z")], ["page_id", "html", "__id", "a.b", "text"])
    assert html_mss.fit(rows) == html_mss.PLAIN
    assert html_mss.extracted(rows, html_mss.PLAIN, text_col="found").collect()[0].asDict() == {
        "page_id": 1, "html": "<p>one", "__id": "x", "a.b": "y", "text": "z", "found": "one"
    }
    assert html_mss.extracted(rows, html_mss.PLAIN).collect()[0]["text"] == "one"


def test_long_page():
    page = "<article>" + "<p>some words of a long page</p>" * 20_000 + "</article>"
    assert html_mss.main_text(page, PLAIN).count("\n\n") == 19_999


# -- url verdicts

URLS = [
    (1, None),
    (2, "no scheme"),
    (3, "http://A.Example.ORG/es/x?y#z"),
    (4, "http://example.org/en/12"),
    (5, "http://x.fr.com/fr/1"),
    (6, "http://casino-win.example.net/en/1"),
    (7, "http://www.casino-win.example.net?q"),
    (8, "http://notcasino-win.example.net/"),
    (9, "http://org"),
    (10, "http://"),
    (10, "http://"),
    (11, "http://ex.com/de/"),
    (12, "http://É.net/a\nb"),
]


def test_rules_and_list(spark):
    listed = spark.createDataFrame([(k,) for k in url_filter.LISTED] + [(None,)], "key string")
    pages = spark.createDataFrame([(i, u, "x") for i, u in URLS], "page_id long, url string, key string")
    found = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.verdicts(pages, listed).collect()}
    assert found[1] == found[2] == found[10] == ("", "", None, "allow")
    assert found[3] == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert found[4][2:] == ("example.org/en/1", "block") and found[5][2:] == ("com/fr/", "allow")
    assert found[6][2:] == (None, "block") and found[7] == ("www.casino-win.example.net", "", None, "block")
    assert found[8][3] == "allow" and found[9][2:] == (None, "allow") and found[11][2:] == ("com/de/", "block")
    assert found[12][:2] == ("É.net", "/a\nb")


def test_cascade_is_exact_over_its_universe(spark):
    keys = [(f"k{i}.example",) for i in range(3000)]
    universe = spark.createDataFrame(keys, "key string")
    for step in (3, 50, 10_000):
        listed = {k for (k,) in keys[1::step]}
        levels = url_filter.build(universe, spark.createDataFrame([(k,) for k in listed] + [("elsewhere",)], "key string"))
        found = {r[0] for r in universe.filter(url_filter.is_listed(universe["key"], levels)).collect()}
        assert found == listed
    assert url_filter.build(universe, spark.createDataFrame([], "key string")) == []
    with pytest.raises(ValueError):
        url_filter.build(universe, universe, max_bytes=16)


# -- WARC


def test_archives_keep_every_record(spark):
    big = "é<p>" * 500
    rows = [(1, "http://a/ b", big), (2, None, big), (3, "u", None), (4, "u", "x"), (5, "u", "x"), (None, "u", big), (2**53 + 1, "u", big + "1"), (6, "u", big), (6, "u", big)]
    found = sorted(map(tuple, warc_normal.archived(spark.createDataFrame(rows, PAGE_SCHEMA), max_file_bytes=3000).collect()), key=str)
    newest = 6
    for page, size, _, kind, refers in found:
        assert (kind, refers) == (("revisit", newest) if size == 2500 and page != newest else ("response", None))
    assert sorted(r[1] for r in found) == [0, 1, 1, 2500, 2500, 2500, 2500, 2500, 2501]
    assert {r[0] for r in found} == {r[0] for r in rows}
    assert warc_normal.archived(spark.createDataFrame([], PAGE_SCHEMA)).count() == 0


def test_members_stand_alone():
    payloads = [b"\r\n\r\n" * i for i in range(9)]
    records = [warc_normal.record_of(i, f"http://h/{i}", p, hashlib.sha1(p).hexdigest(), None) for i, p in enumerate(payloads)]
    stream = zlib.compress(b"".join(records[:5]), 6, 31) + zlib.compress(b"".join(records[5:]), 6, 31)
    archive, index = io.BytesIO(), io.BytesIO()
    assert warc_normal.normalise_file(io.BytesIO(stream), archive, index) == 9
    import json

    for i, line in enumerate(index.getvalue().splitlines()):
        entry = json.loads(line)
        member = archive.getvalue()[entry["offset"] : entry["offset"] + entry["length"]]
        assert zlib.decompress(member, 31) == records[i] and warc_normal.parsed(member)[:2] == (i, 4 * i)
    with pytest.raises(ValueError):
        warc_normal.normalise_file(io.BytesIO(zlib.compress(records[0][:-3], 6, 31)), io.BytesIO(), io.BytesIO())
    changed = warc_normal.record_of(1, "http://h/1", b"other bytes", hashlib.sha1(b"bytes").hexdigest(), None)
    with pytest.raises(ValueError, match="digest"):
        warc_normal.parsed(zlib.compress(changed, 6, 31))


# -- token files


def test_blocks_round_trip():
    rng = np.random.default_rng(2)
    blocks = [rng.integers(0, 50_257, 700), np.tile([5, 7, 65_534, 0], 150), np.zeros(300, int), rng.zipf(1.3, 200) % 50_257, np.array([50_256])]
    coded = token_coder.encode_blocks(blocks)
    for block, back in zip(blocks, token_coder.decode_blocks(coded, [len(b) for b in blocks])):
        assert np.array_equal(block, back)
    # a block's bytes do not depend on its neighbours
    assert token_coder.encode_blocks(blocks[1:2]) == coded[1:2] and len(coded[1]) < 200


class Kept(io.BytesIO):
    def close(self):
        pass


def test_ids_of_any_32_bit_size():
    rng = np.random.default_rng(4)
    blocks = [rng.integers(0, 2**32 - 1, 300), rng.integers(0, 200_000, 250), np.tile([0, 1, 65_535, 65_536, 2**32 - 2], 20), np.array([200_000])]
    coded = token_coder.encode_blocks(blocks)
    for block, back in zip(blocks, token_coder.decode_blocks(coded, [len(b) for b in blocks])):
        assert np.array_equal(block, back)
    with pytest.raises(ValueError):
        token_coder.encode_blocks([np.array([2**32 - 1])])


def test_a_slab_holds_the_blocks_of_a_usual_file(monkeypatch):
    monkeypatch.setattr(token_coder, "BLOCK", 4)
    whole, slabs = token_coder.encode_blocks, []
    monkeypatch.setattr(token_coder, "encode_blocks", lambda blocks: slabs.append(len(blocks)) or whole(blocks))
    ids = np.arange(12_000) * 7919 % 50_257
    # an id that the narrow context tables cannot hold, late in the file
    ids[11_000] = token_coder._WIDE
    out = Kept()
    writer = token_coder.FileWriter(out)
    writer.add(np.arange(1), np.ones(1, bool), np.array([len(ids)]), ids)
    writer.close()
    assert slabs == [3000]
    back = [found for found, _ in token_coder.read_file(io.BytesIO(out.getvalue()))]
    assert np.array_equal(np.concatenate(back), ids)


def test_damage_is_noticed():
    out = Kept()
    writer = token_coder.FileWriter(out)
    writer.add(np.arange(3), np.ones(3, bool), np.array([1, 2000, 999]), np.arange(3000) % 777)
    writer.close()
    good = out.getvalue()
    table = [t for _, t in token_coder.read_file(io.BytesIO(good))][-1]
    assert table[:, 2].tolist() == [1, 2000, 999]
    bad = bytearray(good)
    bad[40] ^= 1
    with pytest.raises(ValueError):
        list(token_coder.read_file(io.BytesIO(bytes(bad))))


ODD = ["", " ", "a  b", "it's  \n x", " lead", "trail ", "a \n b", "a\n b\n\nc", "<|endoftext|> x", "x　 y", "tab\t x", "don't 'll  s", "é ü 日本 語", "x\r\n y", "a" * 300 + " b"]


def test_parts_give_the_tokens_of_whole_texts(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    coder = token_coder.Encoder(path)
    ids, counts = coder.encode(ODD + ODD)
    ends = np.cumsum(counts)
    whole = [coder.tokenizer.encode(t, add_special_tokens=False).ids + [2] for t in ODD]
    assert [ids[e - n : e].tolist() for e, n in zip(ends, counts)] == whole * 2
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, None), (3, "twice")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted(map(tuple, token_coder.token_files(docs, path).collect()), key=lambda r: r[1])
    assert [r[0] for r in found] == sorted((r[0] for r in rows), key=lambda i: -1 if i is None else i)
    assert [r[1] for r in found] == np.cumsum([0] + [r[2] for r in found])[:-1].tolist()
    sums = {(r[0], r[2]): r[3] for r in found}
    for i, own in enumerate(whole):
        assert sums[i, len(own)] == zlib.crc32(np.array(own, "<u4").tobytes())
    assert token_coder.token_files(docs.limit(0), path).count() == 0
