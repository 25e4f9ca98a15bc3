"""Main text of web pages by the maximum-scoring subsequence of words and tags.

A page becomes a sequence of tags and runs of words. Words score above zero (words
of links below), tags below zero; one linear scan finds the contiguous stretch with
the highest sum, and the blocks that it touches are the text.

The weights come from labelled pages: pages with exactly one ``article`` or ``main``
element, whose content is the label. At most ``max_pages`` labelled pages are read
for this (those with the smallest hash of their id), a documented bound. Learned are

* per tag, the log odds of standing in content (tags weigh from -1 to -0.01);
* words, words in a labelled element and words of links (plain ones weigh from 0.1 to
  1, told ones up to 3, those of links at most -0.5);
* per element name and per word of a class, id or role, the log odds that the element
  is or holds content. Outside of the label only the outermost element that holds no
  content is counted, so that a menu is told by ``nav`` and not by its list items.

An element whose lowest log odds are below ``BAD`` gives no text: it is one token of
the sequence with that weight, at least ``MOST_PASSED``, so the scan can pass it inside of an article. Names that
say advert, menu or comment start with ``PRIOR`` elements counted outside; inside of an
article they count for neither side, since the label alone cannot tell.

Only what is never rendered leaves a page before the scan: head, scripts, styles,
templates, drawings, media and elements with ``hidden``.

Text: character references are decoded; white space in a block becomes one space;
blocks are joined by two line ends. Only block elements part blocks; ``br`` is white
space. A null, empty or textless page gives "". Whole pages are read, of any length.
Without any labelled page words weigh 1 (3 in a labelled element), those of links -1, tags -0.5, and the names
keep what they start with. Repeated ids are extracted each; for learning an id counts once, with
the page of smallest hash. Extra columns stay, whatever their names.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratingml.llm.common import quoted

MAX_PAGES = 2_000

#: Fixed names of HTML elements.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td "
    "tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
#: Elements that are never rendered as text.
UNSEEN = frozenset("head script style textarea title xmp iframe noembed noframes noscript template svg math canvas audio video object map".split())
#: Elements that start as no content; ``header`` does outside of an article.
NAMES = frozenset("nav footer aside form button select dialog menu".split())
#: Words of a class, id or role that start as no content.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising advertorial banner breadcrumb breadcrumbs comment comments commentlist "
    "consent cookie cookies copyright disqus disclaimer footer gdpr login masthead menu menubar modal nav navbar navigation navigator newsletter "
    "notice notices notification pager pagination paywall popup promo promoted promotion related replies reply respond search share sharing sidebar "
    "signup skip social sponsor sponsored subscribe subscription toolbar topbar tags teaser toc widget widgets complementary contentinfo "
    "alert alertdialog".split()
)
#: The marks that count for an article of its own: comments and teasers are written as articles, too.
ARTICLE_MARKS = frozenset("ad ads advert advertisement comment comments promo related replies reply sponsored teaser".split())
#: Elements counted outside of content for a name of the lists above, before any page is read.
PRIOR = 20
#: Log odds below which an element gives no text; an unknown name needs four elements outside.
BAD = -2.0
#: A plain word may not outweigh what parts pages.
MOST = 1.0
MOST_TOLD = 3.0
BARRIER = -30.0
#: What an element without text may cost the stretch that passes it.
MOST_PASSED = -1.0
#: What a token may cost inside of an article.
INNER = -0.5

_TAG = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
_LABEL = r"(?i)<(?:article|main)[\s>]"
_LABELLED = re.compile(_LABEL)
_ATTR = re.compile(r"(?:^|\s)(class|id|role|hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_LETTERS = re.compile(r"[A-Za-z]+")


class Part(NamedTuple):
    """A tag, a run of text or an element that gives no text, with its score."""

    score: float
    text: str
    block: int


class Weights(NamedTuple):
    """``by_key``: scores of tags and words; ``other``: unknown tags; ``elements``: log odds per name or class word."""

    by_key: dict[str, float]
    other: float
    elements: dict[str, float] = {}


#: Without any labelled page.
PLAIN = Weights({"word": 1.0, "told": MOST_TOLD, "link": -1.0, **dict.fromkeys(("<article", "</article", "<main", "</main"), BARRIER)}, -0.5)


class Event(NamedTuple):
    """A tag or a run of text; ``features`` tell an opened element."""

    kind: str
    name: str
    features: tuple[str, ...]
    text: str


def _class_words(attributes: str) -> list[str]:
    """The words of class, id and role, without those after has, with, no or without; ``hidden`` for that attribute."""
    words: list[str] = []
    for attribute, value in _ATTR.findall(attributes) if attributes else ():
        if attribute.lower() == "hidden":
            return ["hidden"]
        before = ""
        for word in _LETTERS.findall(_CAMEL.sub(" ", value)):
            word = word.lower()
            if before not in ("has", "with", "no", "without"):
                words.append(word)
            before = word
    return words


def _features(name: str, words: list[str]) -> tuple[str, ...]:
    """What tells an element: the words of its class; its name where that has a meaning or no class is given."""
    if name in ("html", "body"):
        return ()
    if name in ("article", "main"):
        return tuple("." + w for w in words if w in ARTICLE_MARKS)
    own = tuple("." + w for w in words)
    return own + (name,) if not own or name in NAMES or name == "header" else own


def prior(feature: str) -> int:
    return PRIOR if feature in NAMES or feature == "header" or feature[0] == "." and feature[1:] in MARKS else 0


def events(page: str) -> Iterator[Event]:
    """The rendered tags and texts of a page in order; ends of paragraphs and items are made explicit."""
    at, size = 0, len(page)
    unseen, depth = "", 0
    while True:
        found = _TAG.search(page, at)
        end = found.start() if found else size
        if end > at and not unseen:
            yield Event("text", "", (), html.unescape(page[at:end]))
        if found is None:
            return
        at = found.end()
        close, name, attributes = (found[1], found[2], found[3]) if found[2] else (found[4], found[5], found[6])
        if not name:
            continue
        name = name.lower()
        alone = name in VOID or (attributes or "").endswith("/") and name not in BLOCKS and name not in RAW
        if not close and name in RAW:
            # nothing inside is markup
            last = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = last.end() if last else size
            continue
        if unseen:
            if name == unseen:
                depth += -1 if close else 0 if alone else 1
            # a body ends a head that was left open
            if depth == 0 or unseen == "head" and name == "body":
                seen_again = depth != 0
                unseen = ""
                if not seen_again:
                    continue
            else:
                continue
        if close:
            yield Event("close", name, (), "")
            continue
        words = _class_words(attributes)
        if not alone and (name in UNSEEN or words == ["hidden"] and name not in ("html", "body")):
            unseen, depth = name, 1
            continue
        yield Event("alone" if alone else "open", name, _features(name, words), "")


def _tag_key(tag: str, name: str) -> str:
    return tag + name if name in BLOCKS or name in VOID or name in INLINE else "other"


class _Open(NamedTuple):
    name: str
    at: int


def _closed_by(name: str, stack: list[_Open]) -> bool:
    """Whether a tag of this name ends the paragraph or item that is open."""
    return bool(stack) and (stack[-1].name == "p" and name in BLOCKS or stack[-1].name == name == "li")


def counts_of(pages: list[str]) -> Counter:
    """``(key, inside) -> n`` of tags, words and (after ``=``) features of elements on labelled pages."""
    counts: Counter = Counter()
    for page in pages:
        if len(_LABELLED.findall(page)) == 1:
            _count(page, counts)
    return counts


def _count(page: str, counts: Counter) -> None:
    # per element: its features, its parent, whether it holds or is in the content, whether a name tells against it
    features: list[tuple[str, ...]] = []
    parent: list[int] = []
    inside: list[bool] = []
    holds: set[int] = set()
    doubtful: list[bool] = []
    stack: list[_Open] = []
    links = told = 0
    for event in events(page):
        up = stack[-1].at if stack else -1
        doubt = up >= 0 and doubtful[up]
        if event.kind == "text":
            key = "link" if links else "told" if told else "word"
            if not doubt or not told:
                counts[key, told > 0] += len(event.text.split())
            continue
        content = event.name in ("article", "main")
        if event.kind == "close":
            links = 0 if event.name == "a" or event.name in BLOCKS else links
            if any(o.name == event.name for o in stack):
                while stack.pop().name != event.name:
                    pass
            told = max(0, told - 1) if content else told
            counts[_tag_key("</", event.name), told > 0] += 1
            continue
        counts[_tag_key("<", event.name), told > 0] += 1
        if event.kind == "alone":
            continue
        if _closed_by(event.name, stack):
            stack.pop()
            up = stack[-1].at if stack else -1
            doubt = up >= 0 and doubtful[up]
        links = 1 if event.name == "a" else 0 if event.name in BLOCKS else links
        if content:
            holds.update(o.at for o in stack)
            told += 1
        features.append(event.features)
        parent.append(up)
        inside.append(told > 0)
        doubtful.append(doubt or any(prior(f) for f in event.features))
        stack.append(_Open(event.name, len(features) - 1))
    for at, own in enumerate(features):
        if at in holds:
            side = True
        elif inside[at]:
            if doubtful[at]:
                continue
            side = True
        elif parent[at] < 0 or parent[at] in holds:
            side = False
        else:
            continue
        for feature in own:
            counts["=" + feature, side] += 1


def weights_from(counts: dict[tuple[str, bool], int]) -> Weights:
    """Smoothed log odds of content, with the sign that words and tags must have."""
    tags = {k for k, _ in counts if not k.startswith("=")}
    total = {side: sum(n for (k, s), n in counts.items() if s == side and k in tags) + len(tags) + 1 for side in (True, False)}
    odds = {
        k: math.log((counts.get((k, True), 0) + 0.5) / total[True]) - math.log((counts.get((k, False), 0) + 0.5) / total[False])
        for k in tags
    }
    by_key = {k: max(-1.0, min(-0.01, w)) for k, w in odds.items() if k not in ("word", "told", "link")}
    told = odds.get("told", MOST)
    # plain words of labelled pages lie outside by definition, so their weight is that of all words
    words = [sum(counts.get((k, s), 0) for k in ("word", "told")) + 0.5 for s in (True, False)]
    by_key["word"] = min(MOST, max(0.1, math.log(words[0] / total[True]) - math.log(words[1] / total[False])))
    by_key["told"] = min(MOST_TOLD, max(by_key["word"], told))
    by_key["link"] = max(-2.0, min(-0.5, odds.get("link", -1.0)))
    # what separates pages is never content, labelled or not
    for key in ("<article", "</article", "<main", "</main", "<body", "</body", "<html", "</html"):
        by_key[key] = BARRIER
    elements = {
        f: math.log((counts.get(("=" + f, True), 0) + 0.5) / (counts.get(("=" + f, False), 0) + prior(f) + 0.5))
        for f in {k[1:] for k, _ in counts if k.startswith("=")}
    }
    return Weights(by_key, min(-0.5, by_key.get("other", -0.5)), elements)


_PRIOR_ODDS = math.log(0.5 / (PRIOR + 0.5))


def _odds(name: str, features: tuple[str, ...], told: bool, weights: Weights) -> float:
    """The lowest log odds of what tells an element; unknown names tell nothing."""
    low = 0.0
    for feature in features:
        if feature == "header" and told:
            continue
        low = min(low, weights.elements.get(feature, _PRIOR_ODDS if prior(feature) else 0.0))
    return low


def parts_of(page: str, weights: Weights) -> list[Part]:
    """The scored sequence of a page; blocks are numbered."""
    out: list[Part] = []
    known = weights.by_key
    word, link = known["word"], known["link"]
    told_word = known.get("told", word)
    block = links = told = 0
    skipped, depth = "", 0
    for event in events(page):
        if skipped:
            if event.kind == "text":
                continue
            if skipped == "p" and event.name in BLOCKS and not (event.kind == "close" and event.name == "p"):
                # a paragraph ends where a block begins or its parent ends; that tag counts
                skipped = ""
            else:
                if event.name == skipped:
                    depth += {"open": 1, "close": -1}.get(event.kind, 0)
                if depth == 0:
                    skipped = ""
                    block += event.name in BLOCKS
                continue
        if event.kind == "text":
            score = link if links else told_word if told else word
            out.append(Part(score * len(event.text.split()), event.text, block))
            continue
        name, close = event.name, event.kind == "close"
        if event.kind == "open":
            odds = _odds(name, event.features, told > 0, weights)
            if odds < BAD:
                block += name in BLOCKS
                out.append(Part(max(odds, INNER if told else MOST_PASSED), "", block))
                skipped, depth = name, 1
                continue
        if name in BLOCKS:
            block += 1
        if name == "a" or name in BLOCKS:
            links = int(name == "a" and event.kind == "open")
        content = name in ("article", "main")
        if content and close:
            told = max(0, told - 1)
        score = known.get(_tag_key("</" if close else "<", name), weights.other)
        out.append(Part(max(score, INNER) if told and not content else score, " " if name == "br" else "", block))
        if content and event.kind == "open":
            told += 1
    return out


def best_stretch(scores: list[float]) -> tuple[int, int]:
    """The first shortest half-open stretch with the highest sum; (0, 0) if no sum is above 0."""
    best, span, total, start = 0.0, (0, 0), 0.0, 0
    for at, score in enumerate(scores):
        if total <= 0:
            total, start = 0.0, at
        total += score
        if total > best:
            best, span = total, (start, at + 1)
    return span


def main_text(page: str | None, weights: Weights) -> str:
    if not page:
        return ""
    parts = parts_of(page, weights)
    first, last = best_stretch([p.score for p in parts])
    if first == last:
        return ""
    low, high = parts[first].block, parts[last - 1].block
    blocks: dict[int, list[str]] = {}
    for part in parts:
        if low <= part.block <= high and part.text:
            blocks.setdefault(part.block, []).append(part.text)
    joined = (" ".join("".join(texts).split()) for texts in blocks.values())
    return "\n\n".join(t for t in joined if t)


def fit(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", max_pages: int = MAX_PAGES) -> Weights:
    """Weights from at most ``max_pages`` labelled pages; see the module for pages without any label."""
    rows = pages.select(quoted(id_col).alias("__id"), quoted(html_col).alias("__html"))
    labelled = rows.filter("__id IS NOT NULL").filter(F.regexp_count("__html", F.lit(_LABEL)) == 1)
    labelled = labelled.withColumn("__hash", F.xxhash64("__html"))
    ids = labelled.groupBy("__id").agg(F.min("__hash").alias("__hash"))
    ids = F.broadcast(ids.orderBy(F.xxhash64("__id"), "__id").limit(max_pages))
    rows = labelled.join(ids, ["__id", "__hash"]).dropDuplicates(["__id"])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()
        for batch in batches:
            counts.update(counts_of([h for h in batch["__html"] if isinstance(h, str)]))
        yield pd.DataFrame([(k, s, n) for (k, s), n in counts.items()], columns=["key", "inside", "n"])

    found = rows.select("__html").mapInPandas(count, "key string, inside boolean, n long")
    sums = found.groupBy("key", "inside").agg(F.sum("n").alias("n"))
    # names and class words of at most max_pages pages
    counts = {(r["key"], r["inside"]): r["n"] for r in sums.collect()}
    return weights_from(counts) if counts else PLAIN


def extracted(pages: DataFrame, weights: Weights, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """Add the main text of every page."""

    @F.pandas_udf("string")
    def extract(pages: pd.Series) -> pd.Series:
        return pd.Series([main_text(p if isinstance(p, str) else None, weights) for p in pages], dtype="object")

    return pages.withColumn(text_col, extract(quoted(html_col)))
