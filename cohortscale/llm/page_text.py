"""The main text of published pages, by a minimum cut between content and boilerplate."""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements whose whole content is no text of the page: those that reach to the end of the page if
# unclosed, and those that are passed over only up to their end.
_RAW = "script|style|textarea|title|template|iframe"
_HIDDEN = frozenset("noscript svg audio video select button option datalist".split())
_ATTRIBUTES = r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*"
_MARKUP = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({_RAW})(?![\w-]){_ATTRIBUTES}(?:/>|>.*?(?:</\1\s*>|\Z))"
    rf"|<(/?)([a-zA-Z][a-zA-Z0-9-]*)({_ATTRIBUTES})>|<[!?/][^>]*>",
    re.S | re.I,
)
_BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 "
    "h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody tfoot thead tr ul caption".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SPACED = frozenset("br td th wbr img input".split())
# What an opening tag ends, if it is open.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "option": {"option"}}
_NAMES = re.compile(r"(?:^|\s)(?:class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_CUT_NAME = re.compile(r"[a-z]+")
# Words of class, id and role that name boilerplate, and those that name content.
_BOILERPLATE = frozenset(
    "nav navbar navigation menu menus header masthead footer sidebar sidebars aside ad ads adv advert adverts advertisement "
    "advertising banner promo promotion sponsor sponsored cookie cookies consent gdpr notice notices alert popup modal overlay "
    "comment comments respond reply replies discussion disqus share sharing social follow related recommended recommendations "
    "more trending popular subscribe subscription newsletter signup login register search breadcrumb breadcrumbs pagination "
    "pager toolbar widget widgets copyright legal contentinfo complementary form skip tags meta byline teaser teasers paywall".split()
)
_CONTENT = frozenset("article articlebody content post entry story main body text prose".split())
_TAG_COST = {
    "nav": -6.0, "footer": -6.0, "aside": -6.0, "form": -6.0, "menu": -6.0, "header": -4.0, "dialog": -6.0, "search": -6.0,
    "fieldset": -4.0, "article": 4.0, "main": 3.0,
}


@dataclass
class Block:
    """A run of text under one block element: its lean to content, its parent and its depth."""

    parts: list[str] = field(default_factory=list)
    linked: int = 0
    tag: str = ""
    lean: float = 0.0
    parent: int = 0
    depth: int = 0
    text: str = ""


def _own_lean(tag: str, attributes: str) -> float | None:
    """What an element says of the text inside it; None where it says nothing."""
    if tag in ("html", "body"):
        return None
    names: set[str] = set()
    if attributes:
        for found in _NAMES.findall(attributes):
            names.update(_CUT_NAME.findall("".join(found).lower()))
        if re.search(r"\bhidden\b|display:\s*none|aria-hidden\s*=\s*[\"']?true", attributes, re.I):
            return -6.0
    if names & _BOILERPLATE:
        return -6.0
    if tag in _TAG_COST:
        return _TAG_COST[tag]
    return 3.0 if names & _CONTENT else None


def _hidden_ends(tags: list[re.Match[str]]) -> dict[int, int]:
    """Number of the tag that ends each hidden element, by the number of the tag that begins it."""
    begun: dict[str, list[int]] = {}
    ends: dict[int, int] = {}
    for i, found in enumerate(tags):
        tag = (found.group(3) or "").lower()
        if tag not in _HIDDEN:
            continue
        if not found.group(2):
            if not found.group(4).endswith("/"):
                begun.setdefault(tag, []).append(i)
        elif begun.get(tag):
            ends[begun[tag].pop()] = i
    return ends


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in page order, with references decoded and white space single."""
    out: list[Block] = []
    # Open elements: tag, number, what decides on the text inside, whether a link is open.
    stack: list[tuple[str, int, float | None, bool]] = [("", 0, None, False)]
    number, now, at = 0, None, 0

    def add(raw: str) -> None:
        nonlocal now
        if not raw:
            return
        tag, parent, lean, link = stack[-1]
        if now is None:
            if not raw.strip():
                return
            top = next((s for s in reversed(stack) if s[0] in _BLOCKS or not s[0]), stack[0])
            above = next((s[1] for s in reversed(stack[: stack.index(top)]) if s[0] in _BLOCKS or not s[0]), 0)
            now = Block(tag=top[0], lean=lean if lean is not None else 0.0, parent=above, depth=len(stack))
        now.parts.append(raw)
        if link:
            now.linked += len(raw.strip())

    def flush() -> None:
        nonlocal now
        if now is not None:
            now.text = " ".join(html.unescape("".join(now.parts)).split())
            if now.text:
                out.append(now)
        now = None

    tags = list(_MARKUP.finditer(page))
    ends, hidden_to = _hidden_ends(tags), -1
    for i, found in enumerate(tags):
        if i <= hidden_to:
            continue
        add(page[at : found.start()])
        if i in ends:
            hidden_to = ends[i]
            at = tags[hidden_to].end()
            continue
        at = found.end()
        tag = found.group(3)
        if tag is None:
            continue
        tag = tag.lower()
        if tag in _SPACED:
            add(" ")
        if tag in _BLOCKS:
            flush()
        if found.group(2):
            if any(s[0] == tag for s in stack):
                while stack.pop()[0] != tag:
                    pass
            continue
        if tag in _BLOCKS and tag != "li" and stack[-1][0] in ("p", "b", "i", "a", "em", "strong", "span", "u"):
            # A paragraph ends where a block begins; so do the inline elements left open in it.
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == "p":
                    del stack[i:]
                    break
                if stack[i][0] in _BLOCKS:
                    break
        for other in _ENDS.get(tag, ()):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == other:
                    del stack[i:]
                    break
                if stack[i][0] in ("ul", "ol", "dl", "table", "nav", "div"):
                    break
        if tag in _VOID or found.group(4).endswith("/"):
            continue
        number += 1
        own = _own_lean(tag, found.group(4))
        lean = own if own is not None else stack[-1][2]
        stack.append((tag, number, lean, stack[-1][3] or tag == "a"))
    add(page[at:])
    flush()
    return out


def content_cost(block: Block) -> float:
    """How much likelier content than boilerplate a block is, as log odds."""
    n = len(block.text)
    links = min(block.linked / max(n, 1), 1.0)
    score = block.lean - 3.0 * links
    score += 1.0 if n >= 80 else -0.4
    score += 0.6 if block.text[-1] in ".!?:;\"'" else 0.0
    score += 0.6 if block.tag in ("p", "h1", "h2", "h3", "blockquote", "pre") else 0.0
    if block.text.startswith(("©", "Copyright")):
        score -= 3.0
    return score


def label_content(costs: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Side of each node in the least cut: ``costs`` are terminal capacities, ``edges`` smoothness.

    A positive cost ties a node to content, a negative one to boilerplate. Flow is pushed along
    shortest paths, level by level, until none is left.
    """
    n = len(costs)
    source, sink = n, n + 1
    if all(c >= 0 for c in costs) or all(c < 0 for c in costs):
        return [c >= 0 for c in costs]
    out: list[dict[int, float]] = [{} for _ in range(n + 2)]

    def tie(a: int, b: int, there: float, back: float) -> None:
        out[a][b] = out[a].get(b, 0.0) + there
        out[b][a] = out[b].get(a, 0.0) + back

    for i, c in enumerate(costs):
        if c > 0:
            tie(source, i, c, 0.0)
        elif c < 0:
            tie(i, sink, -c, 0.0)
    for a, b, w in edges:
        tie(a, b, w, w)
    while True:
        level = {source: 0}
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for b, room in out[a].items():
                if room > 1e-9 and b not in level:
                    level[b] = level[a] + 1
                    queue.append(b)
        if sink not in level:
            return [i in level for i in range(n)]
        ways = {a: iter(list(out[a])) for a in level}
        path = [source]
        while path:
            a = path[-1]
            if a == sink:
                room = min(out[x][y] for x, y in zip(path, path[1:]))
                for x, y in zip(path, path[1:]):
                    out[x][y] -= room
                    out[y][x] = out[y].get(x, 0.0) + room
                path = [source]
                continue
            for b in ways[a]:
                if level.get(b) == level[a] + 1 and out[a].get(b, 0.0) > 1e-9:
                    path.append(b)
                    ways[a] = iter([b, *ways[a]])
                    break
            else:
                path.pop()
                level.pop(a, None)


def main_text(page: str | None) -> str:
    """The content blocks of a page, joined by an empty line; empty if there are none."""
    found = blocks(page) if page else []
    if not found:
        return ""
    costs = [content_cost(b) for b in found]
    edges, last = [], {}
    for i, b in enumerate(found):
        if i:
            near = 1 + abs(b.depth - found[i - 1].depth) + (b.parent != found[i - 1].parent)
            edges.append((i - 1, i, 1.2 / near))
        if b.parent in last and last[b.parent] != i - 1:
            edges.append((last[b.parent], i, 0.6))
        last[b.parent] = i
    return "\n\n".join(b.text for b, kept in zip(found, label_content(costs, edges)) if kept)


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of each row of ``pages`` (page_id, url, html), a published site.

    The page is cut into blocks of text at block elements. What a block's innermost telling
    element, class or role says, its links and its length give it a cost of being content or
    boilerplate; blocks that follow each other or have one parent are tied, more so the nearer
    they stand in the tree. The least cut labels them, exactly, page by page. The text has
    references decoded once, white space in a block single, and blocks joined by an empty line;
    nothing else is dropped or cut.

    NULL or empty html has an empty text of 0 characters; unclosed or stray tags are passed over; a page of one
    block is judged by its cost alone. One row per row, ids and urls as they are, NULL included; other columns are
    not read.
    """

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py()) for page in batch.column(2)]
            columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    return rows.mapInArrow(extract, f"page_id {kind}, url string, text string, n_chars long")
