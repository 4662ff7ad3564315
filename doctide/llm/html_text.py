"""Main text of web pages by a conditional random field over DOM leaf blocks.

A page is cut into leaf blocks: runs of text between block-level tags, each with its open ancestors. The field's
features are ancestor tags, words of their class, id and role attributes, the kind of the innermost zone (article or
boilerplate), and text measures (length, share of link text, end mark, figures). It is fitted on a bounded sample of
labelled pages (``SAMPLE_PAGES``): pages that mark their article with ``article`` or ``main`` label their own blocks,
and each gives variants in other layouts: zones renamed to classes, articles without any mark, in tables, lists,
preformatted or bare text, with short parts, and boilerplate zones around and inside of them. Viterbi decoding picks
the article's blocks of every whole page.

Null or empty html gives an empty text; a page without a block that reads as article does, too. Very long pages are
read whole, in time linear in their length. Repeated rows give equal rows, ties in decoding go to boilerplate, an empty
table gives no rows (and, to train on, a plain prior). Only the html column and those of ``keep`` are read; ``keep``
may not name text or n_chars.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace
from functools import lru_cache
from math import log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, bound_batches
from .crf import Crf, fit, viterbi

#: Labelled pages that the field is fitted on, at most, and the longest of them in characters.
SAMPLE_PAGES, SAMPLE_CHARS = 80, 20_000
VARIANTS = 4
BLOCK_BYTES = 4 << 20

#: What stands between a tag's name and its end. Quotes count after an equals sign only; nothing is read twice.
_INSIDE = r"(?:[^<>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|(?![\"']))|[\"'])*+"
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)"
    rf"|<(script|style|noscript|template|svg|math|iframe|object|canvas|textarea|select)\b{_INSIDE}>.*?(?:</\2\s*+>|\Z)"
    rf"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)({_INSIDE})>|<[!?][^<>]*+>|<(?=/?[a-zA-Z])[^<>]*+(?:>|\Z)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role|aria-label|itemprop|hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_NAME_PART = re.compile(r"[a-z]+")
#: Fixed values of HTML: elements that begin and end a block, and those without an end tag.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag of the key ends these that are still open beneath the nearest container.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
_BARRIER = frozenset("ul ol dl table tr select div section article body html".split())

TAGS = "article main nav header footer aside form ul ol dl table title head h1 h2 h3 h4 p div section figure blockquote pre button label li a details dialog menu address".split()
#: Words of attributes that tell a zone; those of a line mean the same to the field.
BOILER_WORDS = (
    "nav navbar navigation menu menubar topbar breadcrumb breadcrumbs", "header masthead banner", "footer foot copyright colophon legal", "sidebar side aside rail complementary",
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion promoted dfp adsense", "comment comments commentlist respond reply replies disqus discussion thread", "notice cookie cookies consent gdpr alert warning disclaimer privacy",
    "share sharing social follow tweet", "related recommended more popular trending recent tags tagcloud category widget", "form search login signin signup subscribe newsletter subscription contact", "popup modal overlay lightbox toolbar pagination pager skip hidden",
)
CONTENT_WORDS = "article content contents post entry story text body main page blog news single copy prose"
_BOILER = [frozenset(x.split()) for x in BOILER_WORDS]
_CONTENT = frozenset(CONTENT_WORDS.split())
_COLUMN = {w: k for k, words in enumerate(BOILER_WORDS) for w in words.split()}
_ZONE = {"nav": 0, "header": 1, "footer": 2, "aside": 3, "form": 9, "search": 9, "button": 9, "select": 9, "label": 9, "title": -1, "head": -1, "dialog": 10, "menu": 0}
_TAG_COLUMN = {t: k for k, t in enumerate(TAGS)}
#: Tags that tell a zone by themselves.
BOILER_TAGS = frozenset("nav footer aside form search button select label title head dialog menu header".split())
_KNOWN = frozenset(TAGS) | BOILER_TAGS | {"html", "body"}
WIDTH = 1 + len(TAGS) + len(_BOILER) + 1 + 14 + 4


@dataclass(frozen=True)
class Block:
    """A leaf block: its text, open tags, attribute word groups (of boilerplate by column, -1 for content), share of link text.

    ``zone``: 1 where the innermost ancestor that tells a zone is an article's, -1 where it is boilerplate's, 0 without one.
    """

    text: str
    tags: frozenset[str]
    groups: frozenset[int]
    links: float
    zone: int = 0


@lru_cache(8192)
def _groups(attributes: str) -> frozenset[int]:
    out = set()
    for m in _ATTRIBUTE.finditer(attributes):
        if m[1].lower() == "hidden":
            out.add(10)
            continue
        for w in _NAME_PART.findall((m[2] or m[3] or m[4] or "").lower()):
            if w in _COLUMN:
                out.add(_COLUMN[w])
            elif w in _CONTENT:
                out.add(-1)
    return frozenset(out)


def _zone(tag: str, own: frozenset[int], tags: frozenset[str], zone: int) -> int:
    """The zone inside a new element."""
    if any(g >= 0 for g in own) or (tag in BOILER_TAGS and not (tag == "header" and tags & {"article", "main"})):
        return -1
    return 1 if tag in ("article", "main") or own else zone


class _Stack:
    """Open elements, with the places of each name, so that none is searched for."""

    def __init__(self) -> None:
        self.items: list[tuple[str, frozenset[str], frozenset[int], int]] = [("", frozenset(), frozenset(), 0)]
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def last(self, names: Iterable[str]) -> int:
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=0)

    def push(self, tag: str, own: frozenset[int]) -> None:
        _, tags, groups, zone = self.items[-1]
        self.places.setdefault(tag, []).append(len(self.items))
        if tag in BLOCK_TAGS:
            self.blocks.append(len(self.items))
        self.items.append((tag, tags | {tag} if tag in _KNOWN else tags, groups | own, _zone(tag, own, tags, zone)))

    def cut(self, depth: int) -> None:
        while len(self.items) > depth:
            tag = self.items.pop()[0]
            self.places[tag].pop()
            if tag in BLOCK_TAGS:
                self.blocks.pop()

    def close(self, tag: str) -> None:
        """An end tag; an inline one doesn't reach over an open block."""
        depth = self.last((tag,))
        if depth and (tag in BLOCK_TAGS or not self.blocks or self.blocks[-1] < depth):
            self.cut(depth)

    def begin(self, tag: str) -> None:
        """What a new block ends: an open paragraph, and the elements that its tag closes beneath the nearest container."""
        barrier = _BARRIER - {"tr"} if tag in ("td", "th") else _BARRIER
        while True:
            at = self.last(("p", *CLOSES.get(tag, ())))
            if not at or at < self.last(barrier):
                return
            name = self.items[at][0]
            self.cut(at)
            if name == "p" and tag not in CLOSES:
                return


def leaf_blocks(page: str) -> list[Block]:
    """Leaf blocks in page order, texts with references decoded and white space folded; empty ones left out."""
    out: list[Block] = []
    stack = _Stack()
    pieces: list[str] = []
    linked = 0
    in_link = 0

    def flush() -> None:
        nonlocal pieces, linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                _, tags, groups, zone = stack.items[-1]
                out.append(Block(text, tags, groups, min(linked / len(text), 1.0), zone))
            pieces, linked = [], 0

    def add(raw: str) -> None:
        nonlocal linked
        text = entities.unescape(raw) if "&" in raw else raw
        pieces.append(text)
        if in_link:
            linked += len(text.strip())

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        if m[1] is not None:
            add(m[1])
            continue
        if m[4] is None:
            continue
        tag = m[4].lower()
        if m[3]:
            if tag == "a":
                in_link = max(0, in_link - 1)
            if tag in BLOCK_TAGS:
                flush()
            stack.close(tag)
            continue
        if tag == "a":
            in_link += not m[5].endswith("/")
        if tag == "br":
            pieces.append(" ")
        if tag in BLOCK_TAGS:
            flush()
            stack.begin(tag)
        if tag in VOID_TAGS or m[5].endswith("/"):
            continue
        plain = tag in ("html", "body") or not ("=" in m[5] or "hidden" in m[5])
        stack.push(tag, frozenset() if plain else _groups(m[5]))
    if at < len(page):
        add(page[at:])
    flush()
    return out


_END = frozenset(".!?:;…\"'”»)")
_LAST_WORDS = re.compile(r"©|\(c\)|copyright|all rights reserved|cookies?\b|subscribe|sign (?:in|up)|log ?in\b|advertisement|sponsored|read more|share (?:this|on)|posted by|reply\b|leave a comment|terms of|privacy", re.I)


@lru_cache(4096)
def _place(tags: frozenset[str], groups: frozenset[int]) -> np.ndarray:
    """The part of a block's features that its ancestors give."""
    row = np.zeros(_EXTRA + 1)
    row[0] = 1
    row[[1 + _TAG_COLUMN[t] for t in tags if t in _TAG_COLUMN]] = 1
    row[[_EXTRA if g < 0 else 1 + len(TAGS) + g for g in groups]] = 1
    return row


def features(page: list[Block]) -> np.ndarray:
    if not page:
        return np.zeros((0, WIDTH))
    count, rows = len(page), []
    for i, b in enumerate(page):
        text = b.text
        words = text.count(" ") + 1
        rows.append((
            min(log1p(words) / 4, 1.5), words <= 3, words >= 15, b.links, b.links > 0.6, text[-1] in _END, min((len(text) - len(text.translate(_NO_DIGITS))) / len(text) * 3, 1), words < 60 and _LAST_WORDS.search(text) is not None,
            i == 0, i == count - 1, i / count, not b.tags & _TAG_SET, text.count("|") > 1, text[0].isupper(), b.zone > 0, b.zone < 0, b.zone == 0 and words >= 8, b.links > 0.6 and b.zone > 0 and not b.tags.isdisjoint(_ARTICLE),
        ))
    return np.concatenate([np.stack([_place(b.tags, b.groups) for b in page]), np.array(rows, float)], 1)


_NO_DIGITS = dict.fromkeys(range(48, 58))
_EXTRA = 1 + len(TAGS) + len(_BOILER)
_ARTICLE = frozenset({"article", "main"})
_TAG_SET = frozenset({"p", "li", "h1", "h2", "h3", "h4", "td", "blockquote", "pre"})


def own_labels(page: list[Block]) -> list[int] | None:
    """1 for blocks of the page's marked article that stand in no zone of another kind; None if it marks none."""
    if not any({"article", "main"} & b.tags for b in page):
        return None
    outside = frozenset(t for t, k in _ZONE.items())
    return [int(bool({"article", "main"} & b.tags) and not (b.tags - {"header"}) & outside and not any(g >= 0 for g in b.groups)) for b in page]


#: Layouts of an article: its ancestors' tags, word groups and zone.
_PLAIN = frozenset({"html", "body"})
_LAYOUTS: list[tuple[frozenset[str], frozenset[int], int]] = [
    (_PLAIN | {"article"}, frozenset(), 1), (_PLAIN | {"main"}, frozenset(), 1), (_PLAIN | {"div"}, frozenset({-1}), 1), (_PLAIN | {"div"}, frozenset(), 0),
    (_PLAIN | {"table", "td"}, frozenset(), 0), (_PLAIN, frozenset(), 0), (_PLAIN | {"div", "section"}, frozenset({-1}), 1), (_PLAIN | {"main", "article", "div"}, frozenset({-1}), 1),
]
_PARTS = [{"p"}, {"p"}, {"p"}, {"h2"}, {"h3"}, {"ul", "li"}, {"ol", "li"}, {"blockquote", "p"}, {"table", "td"}, {"pre"}, {"figure"}, {"dl"}, set()]
#: Boilerplate zones: tag and word group (None where the tag tells it).
_ZONES: list[tuple[str, int | None]] = [
    ("nav", None), ("header", None), ("footer", None), ("aside", None), ("form", None), ("div", 0), ("div", 1), ("div", 2), ("div", 3), ("div", 4), ("section", 5), ("div", 5), ("div", 6), ("div", 7), ("section", 8), ("form", 9), ("div", 10),
]


def variants(pages: list[tuple[list[Block], list[int]]], seed: int = 7) -> list[tuple[list[Block], list[int]]]:
    """The labelled pages, and for each of them copies in other layouts, with boilerplate zones around and inside."""
    rng = np.random.default_rng(seed)
    prose = [b.text for blocks_, labels in pages for b, y in zip(blocks_, labels, strict=True) if y][:2000] or ["text"]
    out = list(pages) * 3

    def some(texts: list[str], words: int) -> str:
        return " ".join(texts[int(rng.integers(len(texts)))].split(" ")[: int(rng.integers(1, words))])

    def zone(inside: tuple[frozenset[str], frozenset[int], int]) -> list[tuple[Block, int]]:
        if rng.random() < 0.15:  # links without any mark, which belong to a marked article that holds them
            tags = inside[0] - {"p", "li", "pre"} | [{"table", "td"}, {"ul", "li"}, {"div"}, {"p"}][int(rng.integers(4))]
            own = int(inside[2] > 0 and not inside[0].isdisjoint(_ARTICLE))
            return [(Block(some(prose, 7), frozenset(tags), inside[1], 1.0, inside[2]), own) for _ in range(int(rng.integers(1, 5)))]
        tag, group = _ZONES[int(rng.integers(len(_ZONES)))]
        tags = inside[0] - {"p", "li", "pre"} | {tag} | [{"p"}, {"ul", "li"}, {"div"}, {"label"}, set()][int(rng.integers(5))]
        if tag == "header" and tags & {"article", "main"}:
            tag, group, tags = "aside", None, tags - {"header"} | {"aside"}
        groups = inside[1] | (frozenset() if group is None else {group})
        made = []
        long = rng.random() < (0.6 if tag == "aside" or group in (3, 5, 6) else 0.1)
        for _ in range(int(rng.integers(1, 5))):
            text = prose[int(rng.integers(len(prose)))] if long else some(prose, 9)
            made.append((Block(text, frozenset(tags), groups, float(rng.random() < 0.5) if not long else 0.0, -1), 0))
        return made

    for blocks_, labels in pages:
        for _ in range(VARIANTS):
            layout = _LAYOUTS[int(rng.integers(len(_LAYOUTS)))]
            keep_zones, plain_parts = rng.random() < 0.3, rng.random() < 0.3
            rows: list[tuple[Block, int]] = []
            first = True
            for k, (b, y) in enumerate(zip(blocks_, labels, strict=True)):
                if not y:
                    groups = b.groups | {_ZONE[t] for t in b.tags & {"nav", "footer", "header", "aside"}}
                    tags = b.tags if keep_zones else b.tags - {"nav", "footer", "header", "aside"} | {"div"}
                    rows.append((b if keep_zones else replace(b, tags=tags, groups=groups), 0))
                    continue
                if first:
                    for _ in range(int(rng.integers(0, 3))):
                        rows += zone((_PLAIN, frozenset(), 0))
                head = {"h1", "header"} & b.tags
                part = head if first and head and rng.random() < 0.8 else {"p"} if plain_parts else _PARTS[int(rng.integers(len(_PARTS)))]
                text = b.text if rng.random() < 0.75 or part == {"p"} and not plain_parts else some([b.text], 7)
                last = k + 1 == len(labels) or not any(labels[k + 1 :])
                if last and rng.random() < 0.4:
                    text = some([b.text], 7) + "."
                rows.append((Block(text, layout[0] | part, layout[1], 0.0 if rng.random() < 0.95 else 0.4, layout[2]), 1))
                first = False
                if rng.random() < 0.12:
                    rows += zone(layout)
                elif layout[2] > 0 and not layout[0].isdisjoint(_ARTICLE) and rng.random() < 0.15:  # a list of links in the article
                    tags = layout[0] - {"p", "pre"} | {"ul", "li"}
                    rows += [(Block(some(prose, 7), frozenset(tags), layout[1], 1.0, layout[2]), 1) for _ in range(int(rng.integers(1, 5)))]
            for _ in range(int(rng.integers(0, 4))):
                rows += zone(layout if rng.random() < 0.3 else (_PLAIN, frozenset(), 0))
            out.append(([r[0] for r in rows], [r[1] for r in rows]))
    return out


def train(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> Crf:
    """Fit the field on a bounded sample of pages that label themselves; without any, a plain prior."""
    marked = pages.select(F.xxhash64(id_col, html_col).alias("pick"), F.col(html_col).cast("string").alias("html")).filter((F.length("html") <= SAMPLE_CHARS) & F.lower("html").rlike("<(article|main)[ >]"))
    # The picks first, so that only the picked pages travel whole; both sides are bounded by SAMPLE_PAGES rows.
    picks = [r[0] for r in marked.select("pick").distinct().orderBy("pick").limit(SAMPLE_PAGES).collect()]
    texts = [r["html"] for r in sorted(marked.filter(F.col("pick").isin(picks)).dropDuplicates(["pick"]).collect())] if picks else []
    known = [(b, y) for b in map(leaf_blocks, texts) if b and (y := own_labels(b)) is not None]
    if not known:
        return prior()
    every = variants(known)
    x = np.concatenate([features(b) for b, _ in every])
    y = np.array([k for _, labels in every for k in labels])
    return fit(x, y, np.array([len(b) for b, _ in every]), steps=250)


def prior() -> Crf:
    """What is assumed without labelled pages: zone tags and words speak against a block, length and end marks for it."""
    w = np.zeros((WIDTH, 2))
    base, extra = 1 + len(TAGS), 1 + len(TAGS) + len(_BOILER)
    for t in ("nav", "header", "footer", "aside", "form", "title", "head", "button", "label", "dialog", "menu"):
        w[1 + _TAG_COLUMN[t], 0] = 4
    for t in ("article", "main", "p", "h1"):
        w[1 + _TAG_COLUMN[t], 1] = 1
    w[base:extra, 0] = 4
    w[extra, 1] = 1
    w[extra + 1 + np.array([3, 4, 7]), 0] = 2
    w[extra + 1 + np.array([2, 5, 14, 16]), 1] = 1
    w[extra + 1 + 15, 0] = 2
    w[extra + 1 + 17, 1] = 2
    return Crf(w, np.array([[0.5, 0.0], [0.0, 0.5]]))


def extract(pages: DataFrame, model: Crf, keep: tuple[str, ...] = ("page_id", "url"), html_col: str = "html") -> DataFrame:
    """``keep``, text and n_chars of every page."""
    bound_batches(pages.sparkSession)
    frame = pages.select(*keep, pages[html_col].cast("string").alias("__html"))
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in frame.schema if f.name != "__html") + "text string, n_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "__html", BLOCK_BYTES):
            pages_ = [leaf_blocks(h or "") for h in block.column("__html").to_pylist()]
            lengths = np.array([len(p) for p in pages_], np.int64)
            labels = viterbi(model, np.concatenate([features(p) for p in pages_]), lengths).tolist() if lengths.sum() else []
            texts, at = [], 0
            for p in pages_:
                texts.append("\n".join(b.text for b, y in zip(p, labels[at : at + len(p)], strict=True) if y))
                at += len(p)
            yield from pa.table({**{c: block.column(c) for c in keep}, "text": pa.array(texts, pa.string()), "n_chars": pa.array(map(len, texts), pa.int64())}).combine_chunks().to_batches()

    return frame.mapInArrow(run, schema)
