"""Main text of web pages by minimum cut (operator 1).

A page is read into blocks, the runs of text between block-level tags. A classifier gives each block the odds of being
content. In a flow network the cost of either label is the capacity from the source or to the sink; blocks that follow one
another, and blocks that are near in the document tree, are joined by edges whose capacity is the cost of labelling them
differently. The minimum cut is the labelling of least total cost; the source's side is the content.

Evidence that stands in the markup (an ancestor that is a menu, a footer, a form, an advert, a comment section) is
strong; evidence in the text (length, links, sentence ends) decides where the markup says nothing, with the help of
the neighbours.
"""

from __future__ import annotations

import math
import re
from collections import deque
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, table, text_or_empty

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?"
    r"|<(?P<raw>script|style|noscript|template|textarea|select|svg|math|iframe|object|canvas|title)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+(?:/>|>.*?(?:</(?P=raw)\s*>|\Z))"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>",
    re.DOTALL | re.IGNORECASE,
)
#: Part of a tag that the page's end cuts off.
CUT_OFF = re.compile(r"<[/a-zA-Z!?][^>]*\Z")
NAMED = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
HIDDEN = re.compile(r"\bhidden\b(?!\s*=\s*[\"']?(?:false|until))|display\s*:\s*none|visibility\s*:\s*hidden|aria-hidden\s*=\s*[\"']?true", re.IGNORECASE)
SPACE = re.compile(r"[\x20\x09-\x0D]+")
PARTS = re.compile(r"[a-z]+")
CAMEL = re.compile(r"([a-z])([A-Z])")

BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot "
    "th thead tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What may stand in a head; any other opening tag, or text, ends it.
HEAD_TAGS = frozenset("html head base basefont bgsound link meta noframes".split())
#: An opening tag ends an open element of these kinds, as far up as the nearest of the limits.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",)),
}

#: Evidence of the classifier, in log-odds. Markup first: elements, then words of class, id and role.
CONTENT_TAGS = {"article": 4.0, "main": 3.0}
BOILER_TAGS = {"nav": -9.0, "footer": -9.0, "aside": -9.0, "form": -9.0, "button": -9.0, "dialog": -9.0, "menu": -9.0, "fieldset": -9.0, "header": -6.0}
CONTENT_WORDS = dict.fromkeys("article content entry post story text articlebody maincontent".split(), 1.5)
BOILER_WORDS = dict.fromkeys(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promoted promotion promotions banner banners nav navbar navigation menu menus "
    "breadcrumb breadcrumbs footer foot masthead topbar toolbar sidebar sidebars aside rail widget widgets comment comments reply replies respond disqus discussion "
    "cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login signin search share sharing social "
    "related recommended recommendations trending copyright legal pagination pager skip form complementary contentinfo dialog paywall".split(), -9.0,
)
HEADER_WORDS = frozenset(("header", "masthead"))
ADJACENT, NEAR = 0.35, 0.7


@dataclass(slots=True)
class Node:
    """An open element: tag, evidence of its markup (its own and its ancestors'), and whether it is inside an article."""

    tag: str
    evidence: float
    inside: bool
    number: int
    depth: int
    parent: Node | None


@dataclass(slots=True)
class Block:
    node: Node
    tag: str
    linked: int = 0
    parts: list[str] = field(default_factory=list)
    text: str = ""


def markup_evidence(tag: str, attrs: str, parent: Node | None) -> tuple[float, bool]:
    own = CONTENT_TAGS.get(tag, 0.0) + BOILER_TAGS.get(tag, 0.0)
    inside = (parent.inside if parent else False) or tag in ("article", "main")
    if tag == "header" and inside:
        own = 0.0  # an article's own head line
    if attrs and tag not in ("html", "body"):
        words = set()
        for m in NAMED.finditer(attrs):
            value = CAMEL.sub(r"\1 \2", m[2] or m[3] or m[4] or "")
            for name in value.split():
                parts = PARTS.findall(name.lower())
                if not parts or parts[0] not in ("has", "with", "no", "without", "not"):
                    words.update(parts)
        if inside:
            words -= HEADER_WORDS
        bad = min((BOILER_WORDS[w] for w in words if w in BOILER_WORDS), default=0.0)
        own += bad if bad else max((CONTENT_WORDS[w] for w in words if w in CONTENT_WORDS), default=0.0)
        if HIDDEN.search(attrs):
            own -= 12.0
    above = parent.evidence if parent else 0.0
    # Content markup adds up to a bound only; it can't outweigh a menu or comments inside an article.
    return max(-20.0, min(5.0, above + own)), inside


def read_blocks(html: str) -> list[Block]:
    """The blocks of a page in page order, with white space as one space; blocks without text are left out."""
    root = Node("", 0.0, False, 0, 0, None)
    stack, blocks, current, at, count, links, skipping = [root], [], None, 0, 0, 0, 0

    def add(text: str) -> None:
        nonlocal current
        if skipping and text.strip():
            leave_head()
        if skipping or not text:
            return
        if current is None:
            if not text.strip():
                return
            current = Block(stack[-1], stack[-1].tag)
            blocks.append(current)
        current.parts.append(text)
        if links:
            current.linked += len(text)

    def open_(tag: str, attrs: str) -> None:
        nonlocal count
        count += 1
        parent = stack[-1]
        evidence, inside = markup_evidence(tag, attrs, parent)
        stack.append(Node(tag, evidence, inside, count, parent.depth + 1, parent))

    def close(tags: tuple[str, ...], limits: tuple[str, ...] = ()) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                del stack[i:]
                return
            if stack[i].tag in limits:
                return

    def leave_head() -> None:
        nonlocal skipping
        skipping = 0
        close(("head",))

    for m in TOKEN.finditer(html):
        if m.start() > at:
            add(html[at : m.start()])
        at = m.end()
        name = m["name"]
        if name is None:
            if m["raw"] and current is not None and not skipping:
                current.parts.append(" ")
            continue
        tag, end = name.lower(), m["end"]
        if tag == "a":
            links = 0 if end else 1
        if tag == "head":
            skipping = 0 if end else 1
        elif skipping and not end and tag not in HEAD_TAGS:
            leave_head()
        if tag in BLOCK_TAGS:
            current = None
            links = 0
            if end:
                close((tag,))
                continue
            if stack[-1].tag == "p" or any(n.tag == "p" for n in stack[-3:]):
                close(("p",), ("div", "td", "li", "section", "article", "form", "button"))
            if tag in CLOSES:
                close(*CLOSES[tag])
            if tag not in VOID_TAGS:
                open_(tag, m["attrs"])
        elif tag == "br":
            add(" ")
        elif not end and m["attrs"] and (HIDDEN.search(m["attrs"]) or NAMED.search(m["attrs"])) and tag not in VOID_TAGS and tag != "a":
            # An inline element of its own kind (an advert, a hidden note) counts as a block only if its markup says so.
            evidence, _ = markup_evidence(tag, m["attrs"], stack[-1])
            if evidence < stack[-1].evidence:
                current = None
                open_(tag, m["attrs"])
        elif end and len(stack) > 1 and stack[-1].tag == tag:
            current = None
            close((tag,))
    if at < len(html):
        add(CUT_OFF.sub("", html[at:]))
    kept = []
    for b in blocks:
        b.text = SPACE.sub(" ", unescape("".join(b.parts))).strip("\x20\t\n\x0b\x0c\r")
        if b.text:
            kept.append(b)
    return kept


def odds(block: Block) -> float:
    """Log-odds of being content, from markup and text."""
    words, length = block.text.count(" ") + 1, max(sum(map(len, block.parts)), 1)
    linked = min(block.linked / length, 1.0)
    score = block.node.evidence - 1.0 + 0.8 * math.log(words) - 4.0 * linked
    if block.text[-1] in ".!?:;\"'”’»…)":
        score += 0.8
    if block.tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
        score += 1.0
    return score


def proximity(a: Node, b: Node) -> int:
    """Steps between two elements in the document tree, at most 8."""
    steps = 0
    while a is not b and steps < 8:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


def minimum_cut(gain: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels of least cost: a node with positive gain loses it when False, one with negative gain when True; an edge costs its
    capacity when its ends differ. Maximum flow by shortest augmenting paths in level graphs (both ways on each edge).
    """
    n = len(gain)
    source, sink = n, n + 1
    to: list[int] = []
    room: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def edge(a: int, b: int, there: float, back: float) -> None:
        out[a].append(len(to))
        to.append(b)
        room.append(there)
        out[b].append(len(to))
        to.append(a)
        room.append(back)

    for i, g in enumerate(gain):
        edge(source, i, g, 0.0) if g > 0 else edge(i, sink, -g, 0.0)
    for a, b, w in edges:
        edge(a, b, w, w)
    tiny = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            u = queue.popleft()
            for e in out[u]:
                v = to[e]
                if level[v] < 0 and room[e] > tiny:
                    level[v] = level[u] + 1
                    queue.append(v)
        if level[sink] < 0:
            return [x >= 0 for x in level[:n]]
        tried, path, u = [0] * (n + 2), [], source
        while True:
            if u == sink:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                back = next(i for i, e in enumerate(path) if room[e] <= tiny)
                u = to[path[back] ^ 1]
                del path[back:]
                continue
            moved = False
            while tried[u] < len(out[u]):
                e = out[u][tried[u]]
                if room[e] > tiny and level[to[e]] == level[u] + 1:
                    path.append(e)
                    u, moved = to[e], True
                    break
                tried[u] += 1
            if not moved:
                if u == source:
                    break
                u = to[path.pop() ^ 1]
                tried[u] += 1


def label(blocks: list[Block]) -> list[bool]:
    """True for content. Adjacent blocks are joined, and each block with the next one of the same parent element."""
    gain, edges, last = [odds(b) for b in blocks], [], {}
    for i, b in enumerate(blocks):
        if i:
            edges.append((i - 1, i, ADJACENT + NEAR / (1 + proximity(blocks[i - 1].node, b.node))))
        parent = b.node.parent.number if b.node.parent else -1
        if (j := last.get(parent)) is not None and j < i - 1:
            edges.append((j, i, NEAR / 2))
        last[parent] = i
    return minimum_cut(gain, edges)


def main_text(html: str) -> str:
    """Content blocks in page order, joined by an empty line."""
    blocks = read_blocks(html)
    return "\n\n".join([b.text for b, keep in zip(blocks, label(blocks), strict=True) if keep]) if blocks else ""


def extract(pages: DataFrame, html: str = "html", text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """Replaces `html` by `text` and `n_chars` (code points). NULL or empty html gives an empty text; no row is dropped.

    A row depends on itself only: no shuffle, and a page of any length is read in one pass.
    """

    def run(pages_: pa.Array) -> pa.Array:
        return pa.array([main_text(x) for x in pages_.to_pylist()], pa.string())

    done = pages.withColumn("__main", F.arrow_udf(run, "string")(text_or_empty(html))).drop(html)
    return done.withColumn(text, F.col("__main")).withColumn(n_chars, F.length("__main").cast("long")).drop("__main")


def op1_min_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(prepare(spark), sf_dir, "pages").select("page_id", "url", "html"))

