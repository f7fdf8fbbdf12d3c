"""Main text of web pages by minimum-cut labelling of their blocks.

A page is read into text blocks with their place in the DOM. A linear classifier over a
block's tags, ancestors, class names, links and length gives its log-odds of being content:
positive odds are the capacity from the source, negative odds the capacity to the sink.
Smoothness edges join neighbours in the page and blocks under one parent. A maximum flow
saturates the cheapest cut, and the blocks left on the source's side are the main text.
"""

from __future__ import annotations

import math
import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_text

TOKEN = re.compile(
    r"""<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""
    r"""|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

# HTML's own element classes.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style template noscript iframe svg math object canvas head title textarea select".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rp "
                   "rt s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("td", "th", "tr"), "td": ("td", "th"),
          "th": ("td", "th"), "option": ("option",), "thead": ("td", "th", "tr", "tbody"),
          "tbody": ("td", "th", "tr", "thead", "tbody"), "tfoot": ("td", "th", "tr", "tbody")}
SCOPE = frozenset("ul ol dl table article section main div body html aside nav header footer form".split())

# What the classifier looks for.
BOILER_TAGS = frozenset("nav footer aside form menu dialog button fieldset".split())
MAIN_TAGS = frozenset(("article", "main"))
BOILER_NAMES = frozenset(
    "ad ads advert advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies "
    "copyright disclaimer discussion disqus footer gdpr login masthead menu modal nav navbar navigation newsletter "
    "notice overlay pager pagination popup promo promotion recommended related replies reply respond search share "
    "sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar topbar widget".split())
#: tags and names whose articles are comments or teasers, not the page's own
TEASER_TAGS = frozenset("nav footer aside menu dialog".split())
TEASER_NAMES = frozenset("comment comments discussion disqus recommended related replies reply respond".split())
#: parts that make a compound name tell a state of the element or its layout: comments-open, has-sidebar
STATE_FIRST = frozenset("has is no not with without".split())
STATE_LAST = frozenset("active closed disabled enabled off on open opened".split())
#: last parts of a wrapper's name: sidebar-wrapper
WRAPPERS = frozenset("container content inner layout main outer page wrap wrapper".split())
PAGE_NAMES = frozenset(("header", "top", "alert"))
MAIN_NAMES = frozenset("article content entry main post story".split())

BIAS = -1.0
WEIGHTS = {"main": 3.5, "main_name": 1.5, "boiler": -7.0, "hidden": -14.0, "paragraph": 1.0, "heading": 0.5, "item": -0.5,
           "plain_item": 1.2, "links": -4.0, "words": 0.5, "sentence": 0.5}
NEIGHBOUR = 0.25
SIBLING = 0.5


class _Node:
    __slots__ = ("tag", "main", "named", "boiler", "teaser", "hidden", "link", "parent", "number")

    def __init__(self, tag, main, named, boiler, teaser, hidden, link, parent, number):
        self.tag, self.main, self.named, self.boiler, self.teaser = tag, main, named, boiler, teaser
        self.hidden, self.link, self.parent, self.number = hidden, link, parent, number


def _strength(parts: list[str], main: bool) -> float:
    """How far one name marks boilerplate: 1, or 0.5 where it rather tells a state or the layout
    of an element that may hold the main text."""
    def marks(part):
        return part in BOILER_NAMES or (not main and part in PAGE_NAMES)

    if not any(map(marks, parts)):
        return 0.0
    first, last = parts[0], parts[-1]
    if first in STATE_FIRST or last in STATE_LAST or (not marks(last) and first in MAIN_NAMES):
        return 0.5
    return 0.5 if last in WRAPPERS and not main else 1.0


def _enter(tag: str, attributes: str, up: _Node, number: int) -> _Node:
    """State of an element: what it inherits and what its tag and names add. The innermost mark
    counts: boilerplate in the main element is not main, and a main element in a wrapper with a
    boilerplate name is not boilerplate. Comments and teasers stay so as articles, too."""
    main_tag, strength, named, teaser, hidden = tag in MAIN_TAGS, 0.0, False, False, up.hidden
    center = tag == "main"
    if attributes and tag not in ("html", "body") and not attributes.isspace():
        for name, a, b, c in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), a or b or c
            if name in ("class", "id", "role"):
                for word in value.split():
                    parts = [n.lower() for n in NAME.findall(word)]
                    own = _strength(parts, up.main or main_tag)
                    strength = max(strength, own)
                    teaser = teaser or (own == 1 and not TEASER_NAMES.isdisjoint(parts))
                    named = named or not MAIN_NAMES.isdisjoint(parts)
                    center = center or (name == "role" and parts == ["main"])
            elif name == "hidden" or (name == "aria-hidden" and value == "true") or (
                    name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
                hidden = True
    main, boiler, named = up.main, up.boiler, named or up.named
    if center or (main_tag and not teaser and not up.teaser):
        main, boiler, teaser = True, 0.0, False
    else:
        if tag in BOILER_TAGS or (tag in ("header", "figcaption") and not main):
            strength = 1.0
        if strength == 1:
            main = named = False
        boiler = max(boiler, strength)
        teaser = teaser or up.teaser or tag in TEASER_TAGS
    return _Node(tag, main, named, boiler, teaser, hidden, up.link or tag == "a", up, number)


def blocks(html: str) -> list[tuple[str, float, int]]:
    """Text blocks in page order: (text, log-odds of content, number of the parent element)."""
    root = _Node("html", False, False, 0.0, False, False, False, None, 0)
    stack, out, text, linked = [root], [], [], 0
    number, at, n = 0, 0, len(html)

    def flush():
        nonlocal linked
        if text:
            whole = " ".join("".join(text).split())
            if whole:
                k = len(stack) - 1
                while k and stack[k].tag in INLINE:
                    k -= 1
                out.append((whole, _odds(whole, linked, stack[k]), stack[max(k - 1, 0)].number))
            text.clear()
            linked = 0

    while at < n:
        m = TOKEN.search(html, at)
        stop = m.start() if m else n
        if stop > at:
            piece = unescape(html[at:stop])
            text.append(piece)
            if stack[-1].link:
                linked += len(piece)
        if not m:
            break
        at = m.end()
        slash, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue  # a comment or declaration
        tag = tag.lower()
        if slash:
            if tag not in INLINE:
                flush()
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if tag in INLINE and stack[k].tag not in INLINE:
                    break  # inline elements don't close blocks
            continue
        if tag in RAW and not attributes.endswith("/"):
            if tag not in INLINE:
                flush()
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(html, at)
            if tag == "head" and not end:
                end = re.compile(r"(?=<body)", re.I).search(html, at)
            at = end.end() if end else (n if tag != "head" else at)
            continue
        if tag in INLINE:
            if tag == "br":
                text.append(" ")
            elif tag not in VOID and not attributes.endswith("/"):
                stack.append(_enter(tag, attributes, stack[-1], stack[-1].number))
            continue
        flush()
        closes = CLOSES.get(tag, ())
        for k in range(len(stack) - 1, 0, -1):  # implied end tags, up to the nearest container
            if stack[k].tag == "p" or stack[k].tag in closes:
                del stack[k:]
                if not closes:
                    break
            elif stack[k].tag in SCOPE:
                break
        if tag not in VOID and not attributes.endswith("/"):
            number += 1
            stack.append(_enter(tag, attributes, stack[-1], number))
    flush()
    return out


def _odds(text: str, linked: int, node: _Node) -> float:
    """Log-odds that a block is content."""
    w = WEIGHTS
    if node.hidden:
        return w["hidden"]
    odds = BIAS + w["words"] * math.log2(1 + text.count(" ")) + w["links"] * min(1.0, linked / len(text))
    if node.main:
        odds += w["main"]
    if node.named:
        odds += w["main_name"]
    odds += w["boiler"] * node.boiler
    if node.tag in ("p", "blockquote", "pre"):
        odds += w["paragraph"]
    elif len(node.tag) == 2 and node.tag[0] == "h" and node.tag[1].isdigit():
        odds += w["heading"]
    elif node.tag in ("li", "td", "th", "dt", "dd"):
        # menus are lists of links; an item without any, in no marked place, is as good as a short paragraph
        odds += w["item"] if linked or node.boiler else w["plain_item"]
    if text[-1] in ".!?…\"”»":
        odds += w["sentence"]
    return odds


def min_cut(odds: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Source side of a minimum cut: node i has capacity odds[i] from the source (or -odds[i]
    to the sink), edges are undirected.

    Sources are drained one after the other along shortest residual paths. When one cannot
    drain, what it reaches is closed: no later path can leave that set, so it is final.
    """
    n = len(odds)
    room: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, c in edges:
        room[a][b] = room[a].get(b, 0.0) + c
        room[b][a] = room[b].get(a, 0.0) + c
    left = list(odds)  # what the source still gives, or (negative) the sink still takes
    content = [False] * n
    eps = 1e-9
    for s in range(n):
        while left[s] > eps and not content[s]:
            came, queue, sink = {s: s}, [s], -1
            for v in queue:
                if left[v] < -eps:
                    sink = v
                    break
                for u, c in room[v].items():
                    if c > eps and u not in came and not content[u]:
                        came[u] = v
                        queue.append(u)
            if sink < 0:
                for v in queue:
                    content[v] = True
                break
            flow, v = min(left[s], -left[sink]), sink
            while v != s:
                flow, v = min(flow, room[came[v]][v]), came[v]
            v = sink
            while v != s:
                u = came[v]
                room[u][v] -= flow
                room[v][u] += flow
                v = u
            left[s] -= flow
            left[sink] += flow
    return content


def main_text(html: str) -> tuple[str, int]:
    """Main text of a page, one block a line, and the number of blocks the page has."""
    found = blocks(html)
    edges, last = [], {}
    for i, (_, _, parent) in enumerate(found):
        if i:
            edges.append((i - 1, i, NEIGHBOUR))
        if parent in last:
            edges.append((last[parent], i, SIBLING))
        last[parent] = i
    keep = min_cut([b[1] for b in found], edges)
    return "\n".join(b[0] for b, k in zip(found, keep) if k), len(found)


def extract_main_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars and n_blocks.

    Null or empty html gives the empty text; null keys and urls are passed on; repeated rows
    give repeated rows; other columns are ignored; empty input gives no rows.
    """
    def run(batches):
        for b in batches:
            got = [main_text(h.as_py().decode()) for h in b.column(2)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([t for t, _ in got], pa.string()),
                 pa.array([len(t) for t, _ in got], pa.int64()), pa.array([k for _, k in got], pa.int64())],
                names=["page_id", "url", "text", "n_chars", "n_blocks"])

    rows = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), binary_text(html).alias("h"))
    kinds = [rows.schema[c].dataType.simpleString() for c in ("page_id", "url")]
    return rows.mapInArrow(run, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long, n_blocks long")
