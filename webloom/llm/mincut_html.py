"""Main text of HTML pages by minimum-cut labelling.

A page becomes blocks of text (what stands between block-level tags). A linear classifier gives each
block a cost for either label; the costs are its capacities to source (content) and sink
(boilerplate). Smoothness edges join neighbouring blocks, the stronger the nearer they stand in the
document tree, and blocks that follow one another under one parent. The minimum cut, by Dinic's
maximum flow, is the labelling of least cost; the content side is the text.

Never part of a block: script, style and other tags without text, comments, the head, form controls.
Null, empty and text-less pages give an empty text. Unclosed and crossing tags are taken as browsers
take them where it matters here (a new block ends an open p; an end tag ends what stands open in it).
Rows that repeat a page_id return each. Other columns of the input are ignored. The whole page is used.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][^\s/>]*)|<[!?/][^>]*>", re.S)
_ATTRIBUTES = re.compile(r"((?:\"[^\"]*\"|'[^']*'|[^'\"<>])*)>")
_UNCLOSED = re.compile(r"<!--|<!\[CDATA\[")
_NAMES = re.compile(r"\b(?:class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"\bhidden\b(?!-)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_WORD = re.compile(r"[a-z]+")
# Tags.
SKIP = frozenset("script style noscript template svg canvas iframe object embed audio video map math select option optgroup textarea button datalist title head".split())
RAW = frozenset("script style textarea title iframe noscript template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr input picture source tbody thead tfoot nobr".split())
BOILER = {"nav": 3.0, "footer": 3.0, "aside": 3.0, "form": 3.0, "menu": 3.0, "dialog": 3.0, "header": 2.0, "fieldset": 2.5}
CONTENT = frozenset(["article", "main"])
# Words of class, id and role that speak for boilerplate.
HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising advertorial banner sponsor sponsored promo promotion promoted sidebar side rail nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager footer foot masthead topbar toolbar cookie cookies consent gdpr notice notices notification alert warning popup modal overlay dialog"
    " share sharing social follow subscribe subscription newsletter signup login register related recommended recommendations popular trending widget widgets comment comments commentlist discussion disqus reply replies respond responses reactions review reviews rating search copyright legal disclaimer skip contentinfo complementary".split()
)
HEADER_HINTS = frozenset(["header", "head", "top", "brand", "logo"])
LEVEL = 3.0  # cost that one clear sign is worth
NEAR = 0.9  # capacity of an edge between neighbours under one parent
FAR = 0.5  # its factor for each step further apart in the tree


class Block:
    __slots__ = ("text", "node", "tag", "links", "boiler", "content")

    def __init__(self, text, node, tag, links, boiler, content):
        self.text, self.node, self.tag, self.links, self.boiler, self.content = text, node, tag, links, boiler, content


def blocks(page: str) -> tuple[list[Block], list[int], list[int]]:
    """The blocks of a page in order; of each element of its tree the parent and the depth. Time is in proportion to the page, closed or not."""
    out: list[Block] = []
    up, depth = [-1], [0]
    opened: Counter = Counter()  # open elements by tag
    # open elements: (tag, number, weight against, whether content)
    stack = [("#", 0, 0.0, False)]
    parts: list[str] = []
    state = {"links": 0, "in_link": 0, "skip": 0}

    def flush():
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                tag, node, boiler, content = stack[-1]
                out.append(Block(text, node, tag, min(1.0, state["links"] / len(text)), boiler, content))
            parts.clear()
        state["links"] = 0

    def close(at: int):
        for t, *_ in stack[at:]:
            state["skip"] -= t in SKIP
            opened[t] -= 1
        del stack[at:]

    def text(a: int, b: int):
        if a < b and not state["skip"]:
            t = page[a:b]
            parts.append(t)
            if state["in_link"]:
                state["links"] += len(t.strip())

    at, end, last = 0, len(page), page.rfind(">")
    while at < end:
        m = _TAG.search(page, at, last + 1) if at <= last else None
        if not m:  # no tag can close any more
            rest = _UNCLOSED.search(page, at)
            text(at, rest.start() if rest else end)
            break
        text(at, m.start())
        at = m.end()
        if not m[2]:
            if at == last + 1 and _UNCLOSED.match(m[0]) and not m[0].endswith((("-->", "]]>"))):
                break  # it stays open to the end
            continue
        closing, tag = bool(m[1]), m[2].lower()
        rest = _ATTRIBUTES.match(page, at)
        attrs, at = (rest[1], rest.end()) if rest else (page[at : (close_at := page.find(">", at))], close_at + 1)  # an odd quote or a stray <: the tag ends at the next >
        if tag in INLINE:
            if tag == "a":
                state["in_link"] = 0 if closing else 1
            continue
        flush()
        if tag in VOID:
            continue
        if closing:
            if tag == "body" or tag == "html":
                continue
            for i in range(len(stack) - 1 if opened[tag] else 0, 0, -1):
                if stack[i][0] == tag:
                    close(i)
                    state["in_link"] = 0
                    break
            continue
        if tag in RAW:
            ends = re.compile(rf"</{re.escape(tag)}\s*>?", re.I).search(page, at)
            at = ends.end() if ends else end
            if tag in ("script", "style", "template", "noscript") or tag in SKIP:
                continue
        if tag == "body" and stack[-1][0] in ("head", "html", "#"):
            while len(stack) > 1 and stack[-1][0] == "head":
                close(len(stack) - 1)
        same = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "option": ("select",)}
        if stack[-1][0] == "p":
            close(len(stack) - 1)
        if tag in same and (opened[tag] or opened["dt"] + opened["dd"] + opened["td"] + opened["th"]):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in same[tag]:
                    break
                if stack[i][0] == tag or (tag in ("dt", "dd") and stack[i][0] in ("dt", "dd")) or (tag in ("td", "th") and stack[i][0] in ("td", "th")):
                    close(i)
                    break
        _, _, boiler, content = stack[-1]
        if tag in CONTENT and not boiler:
            content = True
        against = BOILER.get(tag, 0.0)
        if tag == "header" and content:
            against = 0.0
        if attrs and "=" in attrs:
            names = {w for g in _NAMES.findall(attrs) for w in _WORD.findall("".join(g).lower())}
            if tag not in ("body", "html", "article", "main"):
                if names & HINTS:
                    against += LEVEL
                elif names & HEADER_HINTS and not content:
                    against += 1.5
            if not boiler and not against and names & {"article", "content", "main", "post", "entry", "story", "articlebody"} and tag not in ("body", "html"):
                content = True
        if attrs and _HIDDEN.search(attrs):
            against += LEVEL
        if against >= 2:
            content = False
        up.append(stack[-1][1])
        depth.append(len(stack))
        stack.append((tag, len(up) - 1, boiler + against, content))
        opened[tag] += 1
        state["skip"] += tag in SKIP
    flush()
    return out, up, depth


def costs(b: Block, content_seen: bool) -> float:
    """Cost of calling a block boilerplate less that of calling it content (over 0: content is cheaper)."""
    words = b.text.count(" ") + 1
    x = -1.0 * b.boiler
    if content_seen:
        x += LEVEL if b.content else -LEVEL
    x += min(2.0, 0.5 * math.log2(1 + words) - 1.0) if not b.content else 0.5
    x -= 3.0 * b.links if not b.content else 1.0 * b.links
    if b.tag in ("h1", "h2", "h3", "p", "blockquote", "pre"):
        x += 0.5
    return x


def max_flow_side(own: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """The source side of the minimum cut: own[i] is the net capacity of i from the source (or, under 0, to the sink); edges go both ways."""
    n = len(own)
    s, t = n, n + 1
    to: list[int] = []
    cap: list[float] = []
    adj: list[list[int]] = [[] for _ in range(n + 2)]

    def edge(a, b, x, y):
        adj[a].append(len(to))
        to.append(b)
        cap.append(x)
        adj[b].append(len(to))
        to.append(a)
        cap.append(y)

    for i, x in enumerate(own):
        edge(s, i, x, 0.0) if x > 0 else edge(i, t, -x, 0.0)
    for a, b, c in edges:
        edge(a, b, c, c)
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            u = queue.popleft()
            for e in adj[u]:
                if cap[e] > 1e-12 and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [x >= 0 for x in level[:n]]
        nxt = [0] * (n + 2)
        path: list[int] = []
        u = s
        while True:
            if u == t:
                f = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= f
                    cap[e ^ 1] += f
                path, u = [], s
                continue
            while nxt[u] < len(adj[u]):
                e = adj[u][nxt[u]]
                if cap[e] > 1e-12 and level[to[e]] == level[u] + 1:
                    break
                nxt[u] += 1
            else:
                if not path:
                    break
                level[u] = -1
                u = to[path.pop() ^ 1]
                continue
            path.append(e)
            u = to[e]


def content_blocks(page: str) -> list[Block]:
    every, up, depth = blocks(page)
    if not every:
        return []
    seen = any(b.content and not b.boiler for b in every)
    edges = []
    last: dict[int, int] = {}
    for i, b in enumerate(every):
        if i:
            x, y, apart = every[i - 1].node, b.node, 0
            while x != y:  # up to where both meet
                if depth[x] >= depth[y]:
                    x = up[x]
                else:
                    y = up[y]
                apart += 1
            edges.append((i - 1, i, NEAR * FAR ** min(60, max(0, apart - 2))))
        parent = max(0, up[b.node])
        if parent in last and last[parent] != i - 1:
            edges.append((last[parent], i, NEAR / 2))
        last[parent] = i
    side = max_flow_side([costs(b, seen) for b in every], edges)
    return [b for b, ok in zip(every, side, strict=True) if ok]


def main_text(page: str | None) -> str:
    return " ".join(b.text for b in content_blocks(page or ""))


def extract(pages: DataFrame) -> DataFrame:
    """A row for each page: page_id, url, text, n_chars."""

    def run(batches):
        for b in batches:
            texts = [main_text(x.as_py()) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    p = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return p.mapInArrow(run, "page_id long, url string, text string, n_chars long")
