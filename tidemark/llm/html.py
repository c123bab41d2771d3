"""Main text of a page: parser events become lines, and clusters of text-to-tag ratios pick the content region.

The standard library's parser streams events. Each block element's text is a line with its ratio of text to
tags; ratios are smoothed by a Gaussian, and neighbouring lines above a threshold (the lesser of their mean and
spread) form clusters. The lowest element that holds the clusters is the content region, and every line in it
counts, short ones too. Helpers need the clusters' agreement:

* a menu (element, role, or words of class and id) is dropped if its own ratio is under the threshold; where
  no more lines than the smoothing reaches stand beside menus, and ratios tell nothing, if links hold its text;
* an article or main element frames the region if no menu is in a cluster and most of the clusters' text lies
  in such elements;
* where nothing frames the region but the page, it reaches from the first cluster, heading or paragraph to
  the last.

Adverts, asides, footers, page headers, forms, notices, comments and what is not shown are never content: they
are known by element, role or the words of class and id. Inside an article, paragraphs and headings are not
judged by such words, and other elements only by names made of them alone (`ad-slot`, not `share-price`).

Defined cases: null, empty and text-free pages give the empty string; unclosed and stray tags, declarations
and marked sections are tolerated; time grows in proportion to the page, however deep it nests; character
references are decoded; white space in a block becomes one space; equal ratios are one cluster; repeated rows
are each extracted; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import map_rows

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup html li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
_LEAD = frozenset("p h1 h2 h3 h4 h5 h6".split())
_LEAF = _LEAD | frozenset("li dt dd".split())
_NEVER = frozenset("aside footer form script style noscript head template iframe object button select textarea svg math dialog canvas audio video title".split())
_MENU = frozenset(["nav", "menu"])
_ROLES = frozenset("banner contentinfo complementary search dialog alertdialog alert form".split())
_MENU_ROLES = frozenset("navigation menu menubar toolbar".split())
_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense adsbygoogle banner sponsor sponsored sponsors promo promotion sidebar sidebars widget widgets footer masthead cookie cookies consent notice notices gdpr popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments commentlist disqus respond replies reply copyright alert topbar".split()
)
_MENU_WORDS = frozenset("menu menus nav navbar navigation breadcrumb breadcrumbs pagination pager toolbar skip".split())
#: Words that say no more of an element than that it is one.
_PLAIN = frozenset("area articles bar block bottom box button buttons container form icons inline inner items left links list news outer page posts right section site slot stories top unit wrap wrapper".split())
_PAGE_HEADER = frozenset(["header", "heading", "top"])
_TOKENS = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: Gaussian width in lines, and how many lines it reaches to either side.
SIGMA, REACH = 1.0, 3
NONE, MENU, NEVER = 0, 1, 2


class _Node:
    """An element: its place in page order, that of its last descendant, and what encloses it."""

    __slots__ = ("tag", "parent", "order", "last", "never", "menu", "framed", "depth", "text", "linked", "tags")

    def __init__(self, tag: str, parent: _Node | None, order: int, kind: int = NONE, frames: bool = False) -> None:
        self.tag, self.parent, self.order, self.last = tag, parent, order, order
        self.depth = parent.depth + 1 if parent else 0
        self.never = kind == NEVER or (parent is not None and parent.never)
        #: The outermost menu, and the outermost article or main element, around it or itself.
        self.menu = parent.menu if parent and parent.menu else self if kind == MENU else None
        self.framed = parent.framed if parent and parent.framed else self if frames else None
        self.text = self.linked = self.tags = 0  # of a menu


def _kind(tag: str, attrs: dict[str, str | None], parent: _Node) -> int:
    role, inside = (attrs.get("role") or "").lower(), parent.framed is not None
    if tag in _NEVER or "hidden" in attrs or attrs.get("aria-hidden") == "true" or role in _ROLES or _HIDDEN.search(attrs.get("style") or ""):
        return NEVER
    if tag in _MENU or role in _MENU_ROLES:
        return MENU
    if tag == "header" and not inside:
        return NEVER
    if tag in ("body", "html", "article", "main") or (inside and tag in _LEAF):
        return NONE
    kind = NONE
    for name in f"{attrs.get('class') or ''} {attrs.get('id') or ''}".split():
        words = _TOKENS.findall(_CAMEL.sub("-", name).lower())
        if not words or words[0] in ("has", "with", "no", "without"):
            continue
        if inside and not set(words) <= _WORDS | _MENU_WORDS | _PLAIN:
            continue
        if _WORDS & set(words) or (not inside and tag in ("div", "section") and len(words) <= 2 and _PAGE_HEADER & set(words)):
            return NEVER
        if _MENU_WORDS & set(words):
            kind = MENU
    return kind


class _Lines(HTMLParser):
    """Collects (text, tags, element) per block, in page order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack = [_Node("", None, 0)]
        self.places: dict[str, list[int]] = defaultdict(list)  # of open elements on the stack, by tag
        self.regions: list[int] = []
        self.count = self.tags = self.linked = 0
        self.unended = False
        self.found: list[tuple[str, int, _Node]] = []
        self.parts: list[str] = []

    def _flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        node = self.stack[-1]
        if text and not node.never:
            self.found.append((text, self.tags, node))
            if node.menu:
                node.menu.text += len(text)
                node.menu.linked += self.linked
        if node.menu:
            node.menu.tags += self.tags
        self.parts.clear()
        self.tags = self.linked = 0

    def _push(self, tag: str, kind: int, attrs: dict) -> None:
        self.count += 1
        frames = tag in ("article", "main") or (attrs.get("role") or "").lower() == "main" or (attrs.get("itemprop") or "").lower() == "articlebody"
        self.places[tag].append(len(self.stack))
        if tag in ("article", "main", "body", "table"):
            self.regions.append(len(self.stack))
        self.stack.append(_Node(tag, self.stack[-1], self.count, kind, frames))

    def _pop(self) -> None:
        node = self.stack.pop()
        node.last = self.count
        self.places[node.tag].pop()
        if self.regions and self.regions[-1] == len(self.stack):
            self.regions.pop()

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag == "br":
            self.parts.append(" ")
        elif tag == "hr":
            self._flush()
        if tag in _VOID:
            return
        attrs = dict(attrs)
        if tag not in _BLOCK:
            if tag == "a":
                self.places["a"].append(-1)
            elif _kind(tag, attrs, self.stack[-1]) != NONE:  # its text is dropped, its block goes on
                self._push(tag, NEVER, attrs)
            return
        while len(self.stack) > 1 and self.stack[-1].tag not in _BLOCK:
            self._pop()
        self.places["a"].clear()
        self._flush()
        self.tags = 1
        # a block ends an open paragraph; an item or heading ends its own kind
        while self.stack[-1].tag == "p" or (tag in _LEAF and self.stack[-1].tag == tag):
            self._pop()
        self._push(tag, _kind(tag, attrs, self.stack[-1]), attrs)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID and tag not in ("p", "div", "span", "a"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.tags += 1
        if tag == "a":
            if self.places["a"]:
                self.places["a"].pop()
            return
        if tag in _BLOCK:
            self._flush()
        places = self.places.get(tag)
        if not places or (tag in ("p", "span", "b", "i", "li") and self.regions and self.regions[-1] > places[-1]):
            return  # a stray end tag does not reach through a region
        for _ in range(len(self.stack) - places[-1]):
            self._pop()

    def handle_data(self, data):
        if not self.stack[-1].never:
            self.parts.append(data)
            if self.places["a"]:
                self.linked += len(data)

    def parse_html_declaration(self, i):
        """Marked sections are passed over like comments; the library's own handling raises on some."""
        if not self.rawdata.startswith("<![", i):
            return super().parse_html_declaration(i)
        end = self.rawdata.find(">", i)
        return end + 1 if end >= 0 else len(self.rawdata)

    def parse_comment(self, i, report=True):
        """A comment without an end is no comment; that there is none is found once."""
        if self.unended or self.rawdata.find("--", i + 2) < 0:
            self.unended = True
            return i + 4
        end = super().parse_comment(i, report)
        if end < 0:
            self.unended = True
            return i + 4
        return end

    def unknown_decl(self, data):
        pass

    def lines(self, page: str) -> list[tuple[str, int, _Node]]:
        head = page[: page.rfind(">") + 1]  # markup ends there; the library would look for an end of each "<" beyond
        self.feed(head)
        self.close()
        self.handle_data(unescape(page[len(head) :]))
        self._flush()
        while len(self.stack) > 1:
            self._pop()
        self.stack[0].last = self.count
        return self.found


def smooth(values: list[float]) -> list[float]:
    """Each value's Gaussian mean over the lines around it."""
    kernel = [math.exp(-(k * k) / (2 * SIGMA * SIGMA)) for k in range(-REACH, REACH + 1)]
    out = []
    for i in range(len(values)):
        total = weight = 0.0
        for k, w in zip(range(i - REACH, i + REACH + 1), kernel, strict=True):
            if 0 <= k < len(values):
                total += w * values[k]
                weight += w
        out.append(total / weight)
    return out


def threshold(smoothed: list[float]) -> float:
    """The lesser of mean and spread."""
    mean = sum(smoothed) / len(smoothed)
    return min(mean, math.sqrt(sum((x - mean) ** 2 for x in smoothed) / len(smoothed)))


def _around(nodes: list[_Node]) -> _Node:
    """The lowest element that holds all of them, given in page order."""
    found, last = nodes[0], max(n.order for n in nodes)
    while not found.order <= last <= found.last or found.tag in _LEAF:
        found = found.parent
    return found


def extract(page: str | None) -> str:
    """The page's main text, its blocks joined by line feeds."""
    if not page:
        return ""
    found = _Lines().lines(page)
    if not found:
        return ""
    smoothed = smooth([len(text) / max(1, tags) for text, tags, _ in found])
    least = threshold(smoothed)

    others = sum(node.menu is None for _, _, node in found)

    def dropped(menu: _Node | None) -> bool:
        if menu is None:
            return False
        if others <= REACH:
            return 2 * menu.linked >= menu.text
        return menu.text / max(1, menu.tags) < least

    lines = [(text, node, x >= least) for (text, _, node), x in zip(found, smoothed, strict=True) if not dropped(node.menu)]
    if not lines:
        return ""
    dense = [(text, node) for text, node, in_cluster in lines if in_cluster] or [max(((text, node) for text, node, _ in lines), key=lambda x: len(x[0]))]
    framed = sum(len(text) for text, node in dense if node.framed)
    if 2 * framed >= sum(len(text) for text, _ in dense) and framed and not any(node.menu for _, node in dense):
        frames = [node.framed for _, node, _ in lines if node.framed]  # outermost ones, siblings too
        region = _around(frames)
        if region.framed:
            region = region.framed
    else:
        frames, region = [], _around([node for _, node in dense])
    within = [k for k, (_, node, _) in enumerate(lines) if region.order <= node.order <= region.last]
    if region.tag in ("", "html", "body"):  # nothing frames the content: from the first cluster or lead to the last
        ends = [k for k in within if lines[k][2] or _lead(lines[k][1])]
        if frames:
            ends = [k for k in within if lines[k][1].framed]
        first, last = (ends[0], ends[-1]) if ends else (within[0], within[-1])
        within = [k for k in within if first <= k <= last]
    if region.framed is None:  # headings and leads stand before the body, often outside its element
        start = next((k for k in range(within[0]) if _lead(lines[k][1])), within[0])
        within = [*range(start, within[0]), *within]
    return "\n".join(lines[k][0] for k in within)


def _lead(node: _Node) -> bool:
    """Whether a line is a paragraph or heading, or directly in one."""
    return node.tag in _LEAD or (node.parent is not None and node.parent.tag in _LEAD)


def main_text(df: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """key, url, text and its code points, per row."""
    schema = pa.schema([(key, pa.int64()), (url, pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def make():
        def row(k, u, h):
            text = extract(h)
            return k, u, text, len(text)

        return row

    return map_rows(df.select(key, url, html), make, schema)
