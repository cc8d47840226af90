"""Main text of web pages by minimum cut.

A page becomes blocks of text. A linear classifier scores each block; its score is the capacity to the
content or the boilerplate terminal. Neighbours in the page and blocks near each other in the element tree are tied by
smoothness edges. Weights and capacities are trained together on labelled pages, so that the cut of each page is right.
The minimum cut is the labelling of least cost; it separates content from boilerplate.
"""

from __future__ import annotations

import functools
import html
import re
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aisleframe.llm.arrays import slices
from aisleframe.llm.page_labels import PAGES

#: The begin of a tag, comment or declaration, and a tag's attributes up to its end, which quotes can hide.
OPENING = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][a-zA-Z0-9:-]*))")
ATTRIBUTES = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
HINTS = re.compile(r"(?:class|id|role|itemprop|aria-label)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
#: Elements whose content is no text of the page, and those that break a block.
MUTE = frozenset("script style template noscript head title textarea select option svg math iframe object".split())
RAW = frozenset("script style textarea title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split())
#: An element of the key ends an open element of the value.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
        "th": {"td", "th"}, "option": {"option"}}
#: What an element says for itself and all within it, one feature each.
PLACES = {"article": 0, "main": 0, "nav": 1, "footer": 1, "aside": 1, "menu": 1, "dialog": 1, "form": 1, "button": 1}
HEADER, NAMED_NO, NAMED_YES = 2, 3, 4
NAME = re.compile(
    r"(?:^|[\s_-])(?:(?P<no>ads?|advert\w*|banner|sidebar|side-?bar|nav\w*|menu|foot\w*|comments?|commentlist|"
    r"repl(?:y|ies)|respond|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|promo\w*|sponsor\w*|subscribe|newsletter|"
    r"share|sharing|social|related|recommend\w*|breadcrumbs?|widget|login|signup|search|toolbar|pagination|pager|copyright|"
    r"legal|contentinfo|complementary|navigation|skip\w*|disqus\w*|form)|(?P<head>header|masthead)|"
    r"(?P<yes>article\w*|content|post|entry|story|main|body|text|prose))(?=$|[\s_-])", re.I)
#: The element that holds the block, one feature each, after those of the places.
HOLDERS = {e: 5 + i for i, group in enumerate(("h1 h2 h3 h4 h5 h6", "p blockquote pre", "li dt dd", "td th"))
           for e in group.split()}
#: Features in all: places, holders, then one, length, end of a sentence and share of links. Kinds of edges; penalty, steps and first step of training.
PLACED, FEATURES = 9, 13
MOST_CHARS, STOPS = 300, ".!?:;\"'”»…)"
NEXT, SIBLING, COUSIN, PARTED = range(4)
AGAINST = 1 << PLACES["nav"] | 1 << HEADER | 1 << NAMED_NO
PENALTY, STEPS, RATE = 0.3, 200, 0.1
#: Bytes of pages that a task holds as text at a time.
PIECE = 8 << 20


class Block(NamedTuple):
    """Text, its characters inside links, set of places and holder as bits, numbers of the element and of the one above."""

    text: str
    linked: int
    places: int
    parent: int
    above: int


class Model(NamedTuple):
    """Weights of the features and capacities of the edges, in the same unit."""

    weights: tuple[float, ...]
    edges: tuple[float, ...]


def _bits(name: str, attributes: str, inside: bool) -> int:
    """What an element says for content or against it; a header inside an article says nothing."""
    out = 1 << PLACES[name] if name in PLACES else 0
    if name == "header" and not inside:
        out |= 1 << HEADER
    if attributes and name not in ("body", "html"):
        for hint in HINTS.finditer(attributes):
            for word in NAME.finditer(hint[1].strip("\"'")):
                if not word["head"]:
                    out |= 1 << (NAMED_NO if word["no"] else NAMED_YES)
                elif not inside:
                    out |= 1 << HEADER
    return out


def blocks_of(page: str) -> list[Block]:
    """Blocks of text in page order. Each character of the page is read a bounded number of times.

    A tag that never ends takes the rest of the page with it, as in browsers; once a quote never ends, quotes hide no
    more ends of tags.
    """
    out: list[Block] = []
    parts: list[str] = []
    linked, quoted = 0, True
    stack: list[tuple[str, int, int, bool]] = [("", 0, 0, False)]  # element, bits of it and above, number, muted
    opened: Counter[str] = Counter()
    count = 0

    def flush():
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if text:
                top = len(stack) - 1
                while top and stack[top][0] in INLINE:
                    top -= 1
                holder = HOLDERS.get(stack[top][0])
                bits = stack[-1][1] | (0 if holder is None else 1 << holder)
                out.append(Block(text, linked, bits, stack[top][2], stack[max(0, top - 1)][2]))
        linked = 0

    def close(depth):
        for gone in stack[depth:]:
            opened[gone[0]] -= 1
        del stack[depth:]

    at, end = 0, len(page)
    while at < end:
        m = OPENING.search(page, at)
        stop = m.start() if m else end
        if stop > at and not stack[-1][3]:
            piece = page[at:stop]
            parts.append(piece)
            if opened["a"]:
                linked += len(piece.strip())
        if not m:
            break
        at = m.end()
        name = m[2]
        if name is None:
            comment = m[0] == "<!--"
            stop = page.find("-->" if comment else ">", at)
            at = end if stop < 0 else stop + (3 if comment else 1)
            continue
        whole = ATTRIBUTES.match(page, at) if quoted else None
        quoted = whole is not None
        stop = whole.end() if whole else page.find(">", at) + 1
        if not stop:
            break
        attributes, at = page[at:stop - 1], stop
        name = name.lower()
        if m[1]:
            if name not in INLINE:
                flush()
            if opened[name]:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == name:
                        close(i)
                        break
                    if stack[i][0] not in INLINE and name in INLINE:
                        break
            continue
        if name == "br":
            if not stack[-1][3]:
                parts.append(" ")
            continue
        if name not in INLINE:
            flush()
            while len(stack) > 1 and (stack[-1][0] in INLINE and any(s[0] == "p" for s in stack[-4:])
                                      or stack[-1][0] == "p"):
                close(len(stack) - 1)
            ends = ENDS.get(name)
            if ends:
                for i in range(len(stack) - 1, max(0, len(stack) - 5), -1):
                    if stack[i][0] in ends:
                        close(i)
                        break
                    if stack[i][0] in ("ul", "ol", "dl", "table"):
                        break
        if name in VOID or attributes.endswith("/"):
            continue
        if name in RAW:
            stop = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = stop.end() if stop else end
            continue
        count += 1
        inside = bool(opened["article"] or opened["main"])
        stack.append((name, stack[-1][1] | _bits(name, attributes, inside), count, stack[-1][3] or name in MUTE))
        opened[name] += 1
    flush()
    return out


def edges_of(blocks: list[Block]) -> list[tuple[int, int, int]]:
    """Pairs of blocks that tend to agree: the last one in the same element, else the last one in the element above; and
    the one before in the page, if it is another. Pairs of which one alone lies in a place named as boilerplate are a kind
    of their own.
    """
    out, latest, cousins = [], {}, {}

    def tie(a, b, kind):
        parted = bool(blocks[a].places & AGAINST) != bool(blocks[b].places & AGAINST)
        out.append((a, b, PARTED if parted else kind))

    for i, b in enumerate(blocks):
        kin = latest.get(b.parent, -1)
        if kin >= 0:
            tie(kin, i, SIBLING)
        else:
            kin = cousins.get(b.above, -1)
            if kin >= 0:
                tie(kin, i, COUSIN)
        if i and kin != i - 1:
            tie(i - 1, i, NEXT)
        latest[b.parent] = cousins[b.above] = i
    return out


def _told(b: Block) -> tuple[float, float, float, float]:
    """What the text says: one, length, whether it ends a sentence, share of links."""
    n = len(b.text)
    return 1.0, min(1.0, n / MOST_CHARS), float(b.text[-1] in STOPS), min(1.0, b.linked / n)


def scores(blocks: list[Block], model: Model) -> list[float]:
    """Cost of calling each block boilerplate, or if negative, content; its neighbours aside."""
    placed: dict[int, float] = {}
    out = []
    for b in blocks:
        if b.places not in placed:
            placed[b.places] = sum(w for i, w in enumerate(model.weights[:PLACED]) if b.places >> i & 1)
        out.append(placed[b.places] + sum(w * x for w, x in zip(model.weights[PLACED:], _told(b), strict=True)))
    return out


def labelled(page: str) -> tuple[list[Block], list[bool]]:
    """Blocks of a page whose texts begin with + or -, and whether they are content."""
    found = blocks_of(page)
    return [b._replace(text=b.text[1:].strip()) for b in found], [b.text[0] == "+" for b in found]


def train(pages: tuple[str, ...]) -> Model:
    """Weights and capacities of largest margin: the cut of each labelled page should beat every other labelling by the
    number of blocks that differ. Steps go along the difference between the right labelling and the best rival, which
    is itself a minimum cut, and shrink; the mean of the later steps counts. No capacity falls below zero.
    """
    given = []
    for page in pages:
        blocks, content = labelled(page)
        x = np.array([[*(float(b.places >> i & 1) for i in range(PLACED)), *_told(b)] for b in blocks])
        given.append((x, np.array(content), edges_of(blocks)))
    w, mean = np.zeros(FEATURES + PARTED + 1), np.zeros(FEATURES + PARTED + 1)
    for step in range(STEPS):
        slope = PENALTY * w
        for x, right, edges in given:
            score = x @ w[:FEATURES] + np.where(right, -1.0, 1.0)
            rival = np.array(minimum_cut(score.tolist(), [(a, b, w[FEATURES + kind]) for a, b, kind in edges]))
            slope[:FEATURES] += x.T @ (rival.astype(float) - right)
            for a, b, kind in edges:
                slope[FEATURES + kind] += float(right[a] != right[b]) - float(rival[a] != rival[b])
        w -= slope * RATE / (1 + step) ** 0.5
        w[FEATURES:] = np.maximum(w[FEATURES:], 0.0)
        if step >= STEPS // 2:
            mean += w
    mean /= STEPS - STEPS // 2
    return Model(tuple(mean[:FEATURES].tolist()), tuple(mean[FEATURES:].tolist()))


@functools.cache
def default_model() -> Model:
    return train(PAGES)


def minimum_cut(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay on the content side; positive scores tie to content, negative to boilerplate.

    Flow goes from nodes with supply to nodes with demand along shortest ways only, all of one length at a time.
    """
    n = len(scores)
    supply = list(scores)
    near: list[list[int]] = [[] for _ in range(n)]
    goal: list[int] = []
    room: list[float] = []
    for a, b, capacity in edges:
        near[a].append(len(goal))
        near[b].append(len(goal) + 1)
        goal += (b, a)
        room += (capacity, capacity)
    least = 1e-9
    while True:
        level = [-1] * n
        ring = [i for i in range(n) if supply[i] > least]
        sources = ring
        for i in ring:
            level[i] = 0
        depth, met = 0, False
        while ring and not met:
            depth += 1
            further = []
            for u in ring:
                for e in near[u]:
                    v = goal[e]
                    if level[v] < 0 and room[e] > least:
                        level[v] = depth
                        met = met or supply[v] < -least
                        further.append(v)
            ring = further
        if not met:
            return [x >= 0 for x in level]
        arc = [0] * n
        for s in sources:
            way: list[int] = []
            u = s
            while supply[s] > least:
                if supply[u] < -least:
                    amount = min(supply[s], -supply[u], min(room[e] for e in way))
                    supply[s] -= amount
                    supply[u] += amount
                    for e in way:
                        room[e] -= amount
                        room[e ^ 1] += amount
                    for i, e in enumerate(way):  # go on from the first edge without room
                        if room[e] <= least:
                            u = goal[e ^ 1]
                            del way[i:]
                            break
                    continue
                mine = near[u]
                while arc[u] < len(mine):
                    e = mine[arc[u]]
                    if room[e] > least and level[goal[e]] == level[u] + 1 and level[u] < depth:
                        break
                    arc[u] += 1
                else:
                    if not way:
                        break
                    u = goal[way.pop() ^ 1]
                    arc[u] += 1
                    continue
                way.append(e)
                u = goal[e]


def main_text(page: str | None, model: Model | None = None) -> str:
    """Content blocks in page order, two line breaks between them."""
    model = model or default_model()
    found = blocks_of(page or "")
    if not found:
        return ""
    content = minimum_cut(scores(found, model), [(a, b, model.edges[kind]) for a, b, kind in edges_of(found)])
    return "\n\n".join(b.text for b, c in zip(found, content, strict=True) if c)


def _extract(model: Model):
    def run(batches):
        for batch in slices(batches, "html", PIECE):
            texts = [main_text(h, model) for h in batch.column("html").to_pylist()]
            yield pa.record_batch({"page_id": batch.column("page_id"), "url": batch.column("url"),
                                   "text": pa.array(texts, pa.string()),
                                   "n_chars": pa.array([len(t) for t in texts], pa.int64())})

    return run


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
            model: Model | None = None) -> DataFrame:
    """Main text of each page: page_id, url, text, n_chars, one row for each input row.

    A null page is empty and gives an empty text, as does a page without content. Broken markup is read as
    far as it goes. Repeated rows, null ids and further columns do no harm. `model` is trained on the pages of
    `page_labels` unless given.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        F.col(html_col).alias("html"))
    return rows.mapInArrow(_extract(model or default_model()), "page_id long, url string, text string, n_chars long")
