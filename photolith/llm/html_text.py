"""HTML extraction: a page's flat text blocks, classified by a decision tree on shallow features.

A page is cut at block tags into a flat list of text blocks, references decoded, white space folded. Each block has its
word count and link density, those of the blocks before and after it, and two marks that the markup gives: whether it
stands inside an element that names itself as beside the text (nav, footer, class="sidebar", ...) and whether it stands
inside one that names itself as the text (article, main); where the markup says neither, words and links decide. A
decision tree, trained on the small labelled table below, tells main text from the rest; the main blocks are joined by
blank lines.

A name is a whole word of a container's class, id or role, or of a paragraph's class: one of those below, also together
with words that say where or what kind of box it is ("cookie-notice", "site-footer"), but not a part of another name
("related-work"). How much text stands in such an element doesn't matter. An element that holds the page's article, with
none outside of it, is the page's layout, whatever it is called, and so is a form with all that isn't beside the text.

Scripts, styles and other elements that show no text are dropped with all they hold. Markup may be broken: unclosed
tags end with their parent, a head also before what can't stand in one, a cut-off tag at the end is dropped, a cut-off script runs to the end.

Nulls: a null html counts as empty and gives an empty text; a null id or url stays. Repeated rows are extracted each. Empty
tables give no rows. Columns besides page_id, url and html are ignored, whatever their names. Pages are taken whole, of any
length.
"""

from __future__ import annotations

import html
import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from photolith.llm.common import table

#: HTML elements by what they do to text.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
HIDDEN = frozenset("script style noscript template iframe object svg canvas head title select textarea button option datalist".split())
RAW = frozenset("script style noscript template iframe title textarea".split())
#: What a head can hold; anything else ends it, as its end tag may be left out.
IN_HEAD = frozenset("html head base link meta script style noscript template title".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BESIDE_TAGS = frozenset("nav footer aside form menu dialog header".split())
TEXT_TAGS = frozenset("article main".split())
#: Names by which pages call what stands beside the text, as words of class, id and role.
BESIDE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner banners promo promoted promotion sponsor sponsored sidebar side"
    " comment comments commentlist disqus reply replies respond cookie cookies consent gdpr notice notices alert popup modal overlay"
    " newsletter subscribe subscription signup login share sharing social related recommended breadcrumb breadcrumbs pagination"
    " pager menu nav navigation navbar footer header masthead toolbar widget widgets skip complementary contentinfo search"
    " tags meta byline copyright".split()
)
#: Words that stand beside such a name without making it another.
BOX_NAMES = frozenset(
    "area bar block body bottom box column container content entry first form global group inner item items last left link links"
    " list main message outer page panel post primary right section secondary site slot text thread top unit user wrap wrapper zone".split()
)
#: Elements whose class, id and role say what they hold.
CONTAINERS = frozenset("div section ul ol dl li dd table tbody tr td details fieldset center figure main article".split())

#: A comment, a tag (quotes count behind = only), a cut-off tag at the end, text, or a lone <.
_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|$))|<[!?][^>]*>|</?[a-zA-Z](?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*+>|<[a-zA-Z/!?][^>]*$|[^<]+|<", re.S
)
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORDS = re.compile(r"[a-z]+|[A-Z][a-z]*")

#: The labelled table: words and link density of the block before, of the block, and of the block after (-1 words: no
#: such block), inside something that is named as beside the text, inside something that is named as the text, main?
LABELLED = [
    # articles with markup that says so
    (9, 0.0, 10, 0.0, 40, 0.0, 0, 1, 1), (-1, 0.0, 7, 0.0, 120, 0.0, 0, 1, 1), (10, 0.0, 85, 0.0, 60, 0.0, 0, 1, 1),
    (85, 0.0, 2, 0.0, 30, 0.0, 0, 1, 1), (2, 0.0, 1, 0.0, 1, 0.0, 0, 1, 1), (60, 0.0, 45, 0.1, 9, 0.0, 0, 1, 1),
    (120, 0.0, 200, 0.0, 8, 0.0, 0, 1, 1), (30, 0.0, 6, 0.0, 9, 0.1, 0, 1, 1), (1, 1.0, 12, 0.0, 50, 0.0, 0, 1, 1),
    (5, 0.0, 4, 0.0, -1, 0.0, 0, 1, 1), (15, 0.0, 3, 1.0, 40, 0.0, 0, 1, 1), (-1, 0.0, 1, 0.0, -1, 0.0, 0, 1, 1),
    (2, 1.0, 2, 0.0, 4, 0.0, 0, 1, 1), (3, 1.0, 3, 0.0, 3, 0.0, 0, 1, 1), (1, 1.0, 1, 0.0, 2, 1.0, 0, 1, 1), (3, 0.0, 3, 0.0, 2, 1.0, 0, 1, 1),
    (2, 0.0, 2, 1.0, 3, 0.0, 0, 1, 1), (4, 0.0, 4, 0.8, 4, 0.0, 0, 1, 1), (3, 0.0, 3, 0.0, 3, 0.0, 0, 1, 1), (8, 0.0, 9, 0.5, 10, 0.0, 0, 1, 1),
    (1, 1.0, 4, 1.0, 9, 0.0, 0, 1, 1), (7, 0.6, 8, 0.0, 1, 1.0, 0, 1, 1), (2, 1.0, 6, 0.9, -1, 0.0, 0, 1, 1), (12, 0.0, 5, 0.0, 2, 1.0, 0, 1, 1),
    (-1, 0.0, 6, 0.0, 12, 0.0, 0, 1, 1), (6, 0.0, 13, 0.0, 55, 0.0, 0, 1, 1), (1, 1.0, 9, 0.0, 14, 0.0, 0, 1, 1), (75, 0.0, 11, 0.0, -1, 0.0, 0, 1, 1),
    (130, 0.0, 16, 0.0, -1, 0.0, 0, 1, 1), (44, 0.0, 19, 0.1, -1, 0.0, 0, 1, 1), (2, 1.0, 2, 1.0, 2, 1.0, 0, 1, 1), (3, 1.0, 4, 1.0, 30, 0.0, 0, 1, 1),
    (85, 0.0, 3, 1.0, 2, 1.0, 0, 1, 1), (2, 1.0, 7, 0.5, 3, 1.0, 0, 1, 1), (60, 0.0, 12, 0.9, -1, 0.0, 0, 1, 1), (5, 0.0, 8, 0.0, 2, 1.0, 0, 1, 1),
    (3, 1.0, 25, 0.8, 2, 1.0, 0, 1, 1), (-1, 0.0, 3, 1.0, 4, 1.0, 0, 1, 1), (6, 0.4, 10, 0.3, 3, 1.0, 0, 1, 1), (4, 1.0, 6, 0.0, -1, 0.0, 0, 1, 1),
    (1, 1.0, 13, 0.0, 9, 0.0, 0, 1, 1), (2, 1.0, 4, 0.0, 6, 0.0, 0, 1, 1), (35, 0.0, 20, 0.0, -1, 0.0, 0, 1, 1), (180, 0.0, 7, 0.0, -1, 0.0, 0, 1, 1),
    # what names itself as beside the text, inside and outside of articles
    (-1, 0.0, 1, 1.0, 1, 1.0, 1, 0, 0), (1, 1.0, 1, 1.0, 1, 1.0, 1, 0, 0), (1, 1.0, 2, 1.0, 8, 0.0, 1, 0, 0),
    (1, 1.0, 9, 0.0, 11, 0.0, 1, 0, 0), (2, 1.0, 30, 0.0, 7, 0.0, 1, 0, 0), (90, 0.0, 9, 0.0, -1, 0.0, 1, 0, 0),
    (30, 0.0, 12, 0.2, -1, 0.0, 1, 0, 0), (60, 0.0, 25, 0.0, 25, 0.0, 1, 1, 0), (40, 0.0, 8, 0.0, 55, 0.0, 1, 1, 0),
    (55, 0.0, 3, 0.7, 20, 0.0, 1, 1, 0), (20, 0.0, 80, 0.0, 70, 0.0, 1, 0, 0), (70, 0.0, 60, 0.0, 5, 0.5, 1, 0, 0),
    (4, 1.0, 5, 0.0, 6, 0.0, 1, 1, 0), (8, 0.0, 150, 0.0, 12, 0.0, 1, 0, 0), (-1, 0.0, 14, 0.1, 2, 1.0, 1, 0, 0),
    # pages whose markup says nothing: long and link-free blocks, or short ones between such, are text
    (3, 0.0, 60, 0.0, 45, 0.0, 0, 0, 1), (60, 0.0, 45, 0.05, 80, 0.0, 0, 0, 1), (45, 0.0, 12, 0.0, 70, 0.0, 0, 0, 1),
    (80, 0.0, 5, 0.0, 50, 0.0, 0, 0, 1), (10, 0.0, 110, 0.1, 4, 1.0, 0, 0, 1), (50, 0.0, 30, 0.0, 30, 0.0, 0, 0, 1),
    (2, 1.0, 40, 0.0, 35, 0.0, 0, 0, 1), (35, 0.0, 22, 0.0, 40, 0.0, 0, 0, 1), (70, 0.0, 90, 0.2, 2, 1.0, 0, 0, 1),
    (25, 0.0, 8, 0.0, 90, 0.0, 0, 0, 1), (-1, 0.0, 75, 0.0, 60, 0.0, 0, 0, 1), (40, 0.0, 26, 0.0, 3, 1.0, 0, 0, 1),
    # a few short paragraphs, or one, are all that a page has
    (-1, 0.0, 8, 0.0, -1, 0.0, 0, 0, 1), (-1, 0.0, 4, 0.0, -1, 0.0, 0, 0, 1), (-1, 0.0, 9, 0.0, 10, 0.0, 0, 0, 1), (9, 0.0, 10, 0.0, 8, 0.0, 0, 0, 1),
    (10, 0.0, 8, 0.0, -1, 0.0, 0, 0, 1), (-1, 0.0, 5, 0.0, 7, 0.0, 0, 0, 1), (7, 0.0, 9, 0.0, 6, 0.0, 0, 0, 1), (8, 0.0, 7, 0.0, -1, 0.0, 0, 0, 1),
    (-1, 0.0, 3, 0.0, 9, 0.0, 0, 0, 1), (11, 0.0, 11, 0.0, 12, 0.0, 0, 0, 1), (12, 0.0, 12, 0.0, -1, 0.0, 0, 0, 1), (-1, 0.0, 12, 0.0, 11, 0.0, 0, 0, 1),
    # titles: short, before a long block; with an advert or links before them
    (6, 0.0, 10, 0.0, 60, 0.0, 0, 0, 1), (8, 0.0, 12, 0.0, 40, 0.0, 0, 0, 1), (10, 0.0, 14, 0.0, 25, 0.0, 0, 0, 1), (1, 1.0, 11, 0.0, 80, 0.0, 0, 0, 1),
    (12, 0.0, 9, 0.0, 120, 0.0, 0, 0, 1), (5, 0.0, 7, 0.0, 30, 0.0, 0, 0, 1), (4, 0.0, 11, 0.0, 18, 0.0, 0, 0, 1), (1, 1.0, 6, 0.0, 45, 0.0, 0, 0, 1),
    # adverts and notices between links and a title; imprints after the last long block, or after links
    (1, 1.0, 6, 0.0, 10, 0.0, 0, 0, 0), (1, 1.0, 8, 0.0, 12, 0.0, 0, 0, 0), (1, 1.0, 4, 0.0, 11, 0.0, 0, 0, 0), (1, 1.0, 10, 0.0, 14, 0.0, 0, 0, 0),
    (1, 1.0, 12, 0.0, 9, 0.0, 0, 0, 0), (2, 1.0, 5, 0.0, 13, 0.0, 0, 0, 0), (1, 1.0, 13, 0.0, 11, 0.0, 0, 0, 0), (1, 1.0, 9, 0.0, 8, 0.0, 0, 0, 0),
    (60, 0.0, 10, 0.0, -1, 0.0, 0, 0, 0), (120, 0.0, 14, 0.0, -1, 0.0, 0, 0, 0), (45, 0.0, 12, 0.0, -1, 0.0, 0, 0, 0), (80, 0.0, 6, 0.0, -1, 0.0, 0, 0, 0),
    (30, 0.0, 16, 0.0, -1, 0.0, 0, 0, 0), (200, 0.0, 9, 0.0, -1, 0.0, 0, 0, 0), (150, 0.0, 18, 0.0, -1, 0.0, 0, 0, 0), (40, 0.0, 20, 0.1, -1, 0.0, 0, 0, 0),
    # short paragraphs and very short ones among long ones
    (108, 0.0, 40, 0.0, 2, 0.0, 0, 0, 1), (67, 0.0, 10, 0.0, 3, 0.0, 0, 0, 1), (120, 0.0, 8, 0.0, 1, 0.0, 0, 0, 1), (63, 0.0, 2, 0.0, 2, 0.0, 0, 0, 1),
    (66, 0.0, 23, 0.0, 2, 0.0, 0, 0, 1), (120, 0.0, 16, 0.0, 2, 0.0, 0, 0, 1), (2, 0.0, 2, 0.0, 40, 0.0, 0, 0, 1), (3, 0.0, 1, 0.0, 12, 0.0, 0, 0, 1),
    (90, 0.0, 3, 0.0, 11, 0.0, 0, 0, 1), (55, 0.0, 6, 0.0, 8, 0.0, 0, 0, 1), (40, 0.0, 14, 0.0, 4, 0.0, 0, 0, 1), (150, 0.0, 30, 0.0, 1, 0.0, 0, 0, 1),
    # a last paragraph is longer than an imprint
    (60, 0.0, 50, 0.0, -1, 0.0, 0, 0, 1), (100, 0.0, 70, 0.0, 12, 0.0, 0, 0, 1), (50, 0.0, 35, 0.0, -1, 0.0, 0, 0, 1), (90, 0.0, 28, 0.0, 14, 0.0, 0, 0, 1),
    (60, 0.0, 16, 0.0, 13, 0.0, 0, 0, 1), (45, 0.0, 9, 0.0, 14, 0.0, 0, 0, 1), (120, 0.0, 5, 0.0, 60, 0.0, 0, 0, 1), (15, 0.0, 18, 0.0, 12, 0.0, 0, 0, 1),
    (-1, 0.0, 2, 1.0, 2, 1.0, 0, 0, 0), (2, 1.0, 1, 1.0, 2, 1.0, 0, 0, 0), (2, 1.0, 3, 1.0, 40, 0.0, 0, 0, 0),
    (90, 0.0, 4, 1.0, 3, 1.0, 0, 0, 0), (3, 1.0, 5, 0.6, 2, 1.0, 0, 0, 0), (80, 0.0, 10, 0.8, -1, 0.0, 0, 0, 0),
    (2, 1.0, 6, 0.0, 3, 1.0, 0, 0, 0), (4, 1.0, 7, 0.0, -1, 0.0, 0, 0, 0), (2, 1.0, 30, 0.9, 2, 1.0, 0, 0, 0),
    (3, 1.0, 4, 0.0, 5, 0.0, 0, 0, 0), (6, 0.5, 9, 0.4, 2, 1.0, 0, 0, 0),
]


@lru_cache(len(RAW))
def _ends(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I)


def _beside(tag: str, token: str) -> bool:
    if tag in BESIDE_TAGS:
        return True
    if tag not in CONTAINERS and tag != "p" or not ("class" in token or "id" in token or "role" in token):
        return False
    for attribute, *values in _NAMES.findall(token):
        if tag == "p" and attribute.lower() != "class":
            continue
        for name in "".join(values).split():
            words = {w.lower() for w in _WORDS.findall(name)}
            if words & BESIDE_NAMES and words <= BESIDE_NAMES | BOX_NAMES:
                return True
    return False


def blocks(page: str) -> list[tuple[str, int, float, bool, bool]]:
    """(text, words, link density, beside the text, inside the text) of each block in page order."""
    found: list[tuple[str, int, float, bool, bool]] = []
    parts: list[str] = []
    linked: list[str] = []
    open_tags: list[tuple[str, bool, bool, bool, list | None]] = []  # tag, beside, text, hidden, wrapper
    in_link = 0
    # of each element that only its names set beside, or that is a form: text elements around and in it, whether it is a form
    wrappers: list[list[int]] = []
    inside_of: list[list[list[int]]] = []
    texts = 0

    def end_head() -> None:
        while open_tags.pop()[0] != "head":
            pass

    def close() -> None:
        nonlocal parts, linked
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            words = text.count(" ") + 1
            in_links = len(html.unescape(" ".join(linked)).split())
            found.append((text, words, min(in_links / words, 1.0), any(t[1] for t in open_tags), any(t[2] for t in open_tags)))
            inside_of.append([t[4] for t in open_tags if t[4]])
        parts, linked = [], []

    at = 0
    while at < len(page):
        match = _TOKEN.match(page, at)
        token, at = match[0], match.end()
        if token[0] != "<" or token == "<":
            if open_tags and open_tags[-1][0] == "head" and token.strip():
                end_head()
            if not any(t[3] for t in open_tags):
                parts.append(token)
                if in_link:
                    linked.append(token)
            continue
        tag_match = _TAG.match(token)
        if not tag_match or token[-1] != ">":
            continue
        ending, tag = bool(tag_match[1]), tag_match[2].lower()
        if not ending and tag not in IN_HEAD and any(t[0] == "head" for t in open_tags):
            end_head()
        if tag in RAW and not ending:
            end = _ends(tag).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in BLOCK:
            close()
            in_link = 0
        elif tag == "a":
            in_link = 0 if ending else 1
        if tag in VOID or token.endswith("/>"):
            continue
        if ending:
            if any(t[0] == tag for t in open_tags):
                while open_tags and open_tags.pop()[0] != tag:
                    pass
        elif tag in BLOCK or tag in HIDDEN:
            if tag == "p" and open_tags and open_tags[-1][0] == "p":
                open_tags.pop()
            inside = any(t[2] for t in open_tags)
            beside = _beside(tag, token) and not (tag == "header" and inside) and tag not in ("html", "body", "article", "main")
            wrapper = None
            if beside and (tag == "form" or tag not in BESIDE_TAGS):
                wrapper = [sum(t[2] for t in open_tags), 0, int(tag == "form")]
                wrappers.append(wrapper)
                beside = False
            elif tag in TEXT_TAGS and not _beside(tag, token):
                texts += 1
                for _, _, _, _, around in open_tags:
                    if around:
                        around[1] += 1
            open_tags.append((tag, beside, tag in TEXT_TAGS, tag in HIDDEN, wrapper))
    close()
    layout = {id(w) for w in wrappers if w[1] and w[0] + w[1] >= texts}
    if not texts:
        named = [b[3] or any(not w[2] for w in around) for b, around in zip(found, inside_of, strict=True)]
        layout |= {id(w) for w in wrappers if w[2] and all(n or any(w is x for x in around) for n, around in zip(named, inside_of, strict=True))}
    return [(*b[:3], b[3] or any(id(w) not in layout for w in around), b[4]) for b, around in zip(found, inside_of, strict=True)]


def features(page_blocks: list[tuple]) -> list[tuple[float, ...]]:
    """A row of the labelled table, without its label, for each block."""
    rows = []
    for k, (_, words, density, beside, inside) in enumerate(page_blocks):
        before = page_blocks[k - 1][1:3] if k else (-1, 0.0)
        after = page_blocks[k + 1][1:3] if k + 1 < len(page_blocks) else (-1, 0.0)
        rows.append((*before, words, density, *after, float(beside), float(inside)))
    return rows


class DecisionTree:
    """A binary tree that splits where the labels' Gini impurity falls most."""

    def __init__(self, rows: list[tuple], labels: list[int], depth: int = 10) -> None:
        self.label = int(2 * sum(labels) >= len(labels))
        self.split: tuple | None = None
        if depth and 0 < sum(labels) < len(labels):
            best = min(((self._impurity(rows, labels, f, at), f, at) for f in range(len(rows[0])) for at in self._cuts(rows, f)), default=None)
            if best:
                _, f, at = best
                halves = [[(r, y) for r, y in zip(rows, labels, strict=True) if (r[f] > at) == side] for side in (False, True)]
                self.split = (f, at, *(DecisionTree([r for r, _ in h], [y for _, y in h], depth - 1) for h in halves))

    @staticmethod
    def _cuts(rows: list[tuple], f: int) -> list[float]:
        values = sorted({r[f] for r in rows})
        return [(a + b) / 2 for a, b in zip(values, values[1:], strict=False)]

    @staticmethod
    def _impurity(rows: list[tuple], labels: list[int], f: int, at: float) -> float:
        total = 0.0
        for side in (False, True):
            ys = [y for r, y in zip(rows, labels, strict=True) if (r[f] > at) == side]
            total += len(ys) * (p := sum(ys) / len(ys)) * (1 - p)
        return total

    def predict(self, row: tuple) -> int:
        node = self
        while node.split:
            f, at, low, high = node.split
            node = high if row[f] > at else low
        return node.label


@lru_cache(1)
def default_tree() -> DecisionTree:
    return DecisionTree([r[:-1] for r in LABELLED], [r[-1] for r in LABELLED])


def main_text(page: str, tree: DecisionTree | None = None) -> str:
    tree = tree or default_tree()
    found = blocks(page)
    return "\n\n".join(b[0] for b, row in zip(found, features(found), strict=True) if tree.predict(row))


@F.pandas_udf(StringType())
def extract(pages: pd.Series) -> pd.Series:
    tree = default_tree()
    return pages.fillna("").map(lambda page: main_text(page, tree))


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, html) -> (page_id, url, text, n_chars)."""
    texts = pages.select("page_id", "url", extract("html").alias("text"))
    return texts.withColumn("n_chars", F.length("text").cast("long"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
