"""Main text of web pages by the maximum-scoring contiguous region.

A page is read as a row of tokens. Each word scores by the containers it stands in (sections and divisions
with their classes), each tag scores below zero; both weights are log odds from labelled pages. One linear
scan finds the contiguous region with the largest sum. Words inside it that stand in a container of
negative weight (an advert, a form, comments) are left out. A text's home is the article or main element
around it, or else its container. Where such words stand between texts of one home that holds them, they
and their tags cost nothing; and from its second text on, a home's tags cost at most half of what the words
behind them score. So neither an advert nor a list of short items cuts an article. Scripts, styles, comments and the head score
nothing. Containers that no labelled page shows get a weight only if their tag or class names page
furniture.

Text is decoded, white space in a block becomes one space, blocks are joined by a line feed. A null or
empty html, and a page without a positive word, give the empty text. Repeated rows each get their text;
other columns stay.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches

TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>",
    re.S,
)
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
#: Elements whose content is no text of the page.
SKIPPED = {"script", "style", "noscript", "template", "textarea", "select", "svg", "iframe", "object", "head", "title"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Elements that may hold a part of a page; only these weigh on the words in them.
CONTAINERS = {"article", "main", "section", "div", "nav", "header", "footer", "aside", "form", "dialog", "menu", "figure", "table"}
INLINE = {
    "a", "abbr", "b", "bdi", "bdo", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s",
    "samp", "small", "span", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img", "input", "button",
}
FURNITURE_TAGS = {"nav", "header", "footer", "aside", "form", "dialog", "menu", "button"}
#: Words of class names, ids and roles that name page furniture.
FURNITURE = {
    "ad", "ads", "advert", "adverts", "advertisement", "alert", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent",
    "cookie", "cookies", "discussion", "discussions", "disqus", "feedback", "footer", "form", "guestbook", "header", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice",
    "notices", "opinions", "pagination", "popup", "promo", "reactions", "related", "remarks", "replies", "reply", "responses", "search", "share", "sharing", "sidebar", "social",
    "sponsor", "sponsored", "subscribe", "toolbar", "widget",
}
DEFAULT_WORD, FURNITURE_WORD, TAG = 1.0, -2.0, -0.2


@dataclass
class Text:
    """A run of text: its block, the containers around it (outer first) and the tags passed since the last run."""

    text: str
    block: int
    inside: tuple[str, ...]
    tags: list[str]
    words: int = 0
    places: tuple[tuple[int, str], ...] = ()

    @property
    def home(self) -> tuple[int, str] | None:
        """The innermost article or main element around the text, or else its innermost container, by where it begins."""
        return next((p for p in reversed(self.places) if p[1] in ("article", "main")), self.places[-1] if self.places else None)


@dataclass
class Weights:
    word: dict[str, float] = field(default_factory=dict)
    tag: dict[str, float] = field(default_factory=dict)

    def of_words(self, inside: tuple[str, ...]) -> float:
        """The lowest weight of the containers that are known or named as furniture, else the default."""
        low = DEFAULT_WORD
        for key in inside:
            w = self.word.get(key)
            if w is None and _furniture(key) and not (key == "header" and "article" in inside):
                w = FURNITURE_WORD
            if w is not None:
                low = min(low, w)
        return low


def _furniture(key: str) -> bool:
    tag, _, name = key.partition(".")
    return tag in FURNITURE_TAGS if not name else any(part in FURNITURE for part in re.split(r"[^a-z0-9]+", name))


def _keys(tag: str, attributes: str) -> list[str]:
    names = [n for m in NAMES.finditer(attributes) for n in (m[1] or m[2] or m[3] or "").lower().split()] if "=" in attributes else []
    return [tag, *(f"{tag}.{n}" for n in names)]


def texts_of(page: str) -> list[Text]:
    """The runs of text of a page in order."""
    out: list[Text] = []
    open_: list[tuple[str, list[str], int]] = []
    places = lambda: tuple((start, tag) for tag, keys, start in open_ if keys)
    tags: list[str] = []
    block = at = 0
    skip_to = None

    def text(raw: str) -> None:
        nonlocal tags
        if raw and (raw.strip() or out):
            decoded = entities.unescape(raw)
            out.append(Text(decoded, block, tuple(k for _, ks, _ in open_ for k in ks), tags, len(decoded.split()), places()))
            tags = []

    for m in TOKEN.finditer(page):
        if m.start() < at:
            continue
        text(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing = bool(m[1] or m[4])
        tags.append(tag)
        if tag in SKIPPED and not closing:
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            if tag == "head" and not end:
                end = re.compile(r"<body\b", re.I).search(page, at)
                at = end.start() if end else at
            else:
                at = end.end() if end else len(page)
            continue
        if tag == "br":
            out.append(Text(" ", block, tuple(k for _, ks, _ in open_ for k in ks), [], 0, places()))
            continue
        if tag not in INLINE:
            block += 1
        if closing:
            for k in range(len(open_) - 1, -1, -1):
                if open_[k][0] == tag:
                    del open_[k:]
                    break
        elif tag not in VOID:
            if tag not in INLINE:  # a paragraph ends where the next block begins
                for k in range(len(open_) - 1, -1, -1):
                    if open_[k][0] in CONTAINERS:
                        break
                    if open_[k][0] == "p":
                        del open_[k:]
                        break
            open_.append((tag, _keys(tag, m[3] or m[6] or "") if tag in CONTAINERS else [], m.start()))
    text(page[at:])
    return out


def extract(page: str | None, weights: Weights) -> str:
    if not page:
        return ""
    texts = texts_of(page)
    score = [t.words * weights.of_words(t.inside) for t in texts]
    homes = [t.home if s > 0 else None for t, s in zip(texts, score, strict=True)]
    until = {h: k for k, h in enumerate(homes) if h}
    seen: set[tuple[int, str]] = set()
    best = total = 0.0
    first = begin = last = -1
    for k, t in enumerate(texts):
        if score[k] <= 0 and any(p in seen and until[p] > k for p in t.places):
            continue
        cost = sum(weights.tag.get(x, TAG) for x in t.tags)
        if homes[k] in seen:
            cost = max(cost, -score[k] / 2)
        elif homes[k]:
            seen.add(homes[k])
        total += cost
        if total <= 0:
            total, begin = 0.0, k
        total += score[k]
        if total > best + 1e-9:
            best, first, last = total, begin, k
    if last < 0:
        return ""
    blocks: dict[int, list[str]] = {}
    for k in range(first, last + 1):
        if not texts[k].words or score[k] > 0:
            blocks.setdefault(texts[k].block, []).append(texts[k].text)
    return "\n".join(b for b in (" ".join("".join(p).split()) for p in blocks.values()) if b)


def marked(t: Text) -> bool:
    """The author's own label: the text is in an article, and in no container inside it that is named as furniture."""
    if "article" not in t.inside:
        return False
    return not any(_furniture(k) for k in t.inside[t.inside.index("article") :] if k != "header")


def fit(pages: list[str], inside=marked) -> Weights:
    """Weights from labelled pages; ``inside`` is the label of a run of text."""
    words, tags = {True: Counter(), False: Counter()}, {True: Counter(), False: Counter()}
    for page in pages:
        for t in texts_of(page):
            label = bool(inside(t))
            tags[label].update(t.tags)
            for key in set(t.inside):
                words[label][key] += t.words
    odds = lambda n, k, top: max(-3.0, min(top, math.log((n[True][k] + 1) / (n[False][k] + 1))))
    word = {k: odds(words, k, DEFAULT_WORD) for k in sorted({*words[True], *words[False]})}
    # A bare division says nothing where divisions with a class are told apart.
    word.pop("div", None)
    word.pop("section", None)
    all_in, all_out = sum(tags[True].values()) + 1, sum(tags[False].values()) + 1
    tag = {k: max(-2.0, min(-0.05, math.log((tags[True][k] + 1) / all_in * all_out / (tags[False][k] + 1)) - 0.5)) for k in {*tags[True], *tags[False]}}
    return Weights(word, tag)


def train(pages: DataFrame, size: int = 1000) -> Weights:
    """Learn from a bounded sample of pages that mark one article: ``size`` of them, by the hash of their ids."""
    ids = pages.filter(F.col("html").isNotNull() & (F.regexp_count("html", F.lit("<article[ >]")) == 1)).select("page_id")
    ids = ids.orderBy(F.xxhash64("page_id"), "page_id").limit(size).distinct().select(F.col("page_id").alias("_id"))
    rows = pages.select("page_id", "html").join(F.broadcast(ids), F.col("page_id") == F.col("_id"))
    return fit(sorted(r["html"] for r in rows.select("html").collect() if r["html"]))


def main_text(weights: Weights, html: Column, spark: SparkSession) -> Column:
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(weights)

    @F.pandas_udf("string")
    def run(pages: pd.Series) -> pd.Series:
        return pd.Series([extract(p, shared.value) for p in pages], dtype=object)

    return run(html)
