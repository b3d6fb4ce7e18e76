"""Main text of web pages by minimum-cut labelling.

A page is read into text blocks: runs of text between block-level tags.  A
linear classifier turns tags, class names, link share and length into each
block's cost of being content or boilerplate.  These costs are capacities to the
two terminals; neighbouring blocks, and blocks next to each other under one
parent, are joined by edges that weigh more the nearer they lie in the tree.
The minimum cut, found by maximum flow, is the labelling of least total cost.
A linked sentence between paragraphs is cheaper to keep with them than to cut
out, while in a list of links each link adds to the cost of keeping it.  What
names itself page furniture has a cost that its few edges cannot outweigh.

There are no labels for pages, so the weights are fixed parameters.  A class or
id speaks against its element only where the name as a whole says so: its last
part is a furniture word, or its first is one and the rest is a plain container
word (``site-nav``, ``comment-list``, but not ``ad-free`` or ``related-work``).
The name of an element that holds half of the page with its article or main
part says nothing, and inside an article a header is the article's own.

What a browser never shows as text (scripts, styles, templates, form controls,
comments, hidden elements) is no block at all.  Character references are
decoded, white space inside a block becomes one space, blocks are trimmed and
joined in page order by a line feed; nothing else is dropped and no length is
capped.

Edge cases: null or empty html, or a page without content, gives the empty
text.  Unclosed and misnested tags, a page that breaks off inside a tag, and
any size of page are read to their end.  Other columns, nulls in them, repeated
rows and an empty table pass through untouched.
"""

from __future__ import annotations

import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape
from math import log1p

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .rows import map_rows, quoted

# ---- fixed tag and word lists of HTML and of common page furniture
SILENT = frozenset("script style noscript template head title iframe object canvas audio video select option optgroup datalist button textarea label input fieldset legend annotation svg".split())
RAW = frozenset("script style textarea title noscript iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
#: An open element that ends when one of these begins.
CLOSES = {"p": BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "thead", "tfoot"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option", "optgroup"}}
FURNITURE_TAGS = frozenset("nav footer aside form menu dialog header".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar".split())
MAIN = frozenset("article main".split())
BAD_WORDS = frozenset("ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist disqus reply replies respond consent cookie cookies copyright footer footnav gdpr header masthead login signup signin register menu menubar modal popup overlay nav navbar navigation newsletter notice notices subscribe subscription notice notification alert pager pagination promo promoted promotion related recommended recommendations share sharing social sidebar sponsor sponsored sponsors toolbar topbar widget widgets".split())
OWN_HEADERS = frozenset("header masthead".split())
CONTAINER_WORDS = frozenset("area articles bar block body bottom box button buttons col column container content form group inner item items left link links list main outer panel placeholder posts right row section slot text top unit wrap wrapper".split())
STATE_WORDS = frozenset("has is js no with without".split())
GOOD_WORDS = frozenset("article content contents entry main post story body text copy page prose".split())

# ---- weights of the classifier
TAG_COST, NAME_COST, MAIN_GAIN, GOOD_GAIN = -6.5, -5.5, 4.0, 2.0
#: What an article's tag says for the furniture inside it.
INSIDE = 0.2
#: A block outside the marked main part of a page, where that part holds half of the words.
OUTSIDE = -2.0
LINKED, LENGTH, MOST_LENGTH, SENTENCE = -4.0, 0.8, 2.5, 0.5
NEIGHBOUR, SIBLING = 4.5, 0.5
#: What is left of an edge that crosses the border of page furniture.
BORDER = 0.2

# quotes count only right after an equals sign; elsewhere they are part of a name or value
_VALUE = r"""\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^\s>\"'][^\s>]*+"""
_TOKEN = re.compile(rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|</(?:[^a-zA-Z>][^>]*)?(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:{_VALUE})?)?)*+)(?:>|\Z)", re.S)
_ATTR = re.compile(rf"([^\s/>][^\s/>=]*+)(?:\s*+=\s*+({_VALUE})?)?")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_SPACES = re.compile(r"\s+")


@dataclass
class Mark:
    """An element that looks like page furniture."""

    cost: float
    by_name: bool
    outer: Mark | None
    words: int = 0
    holds_main: bool = False
    least: float | None = None  # cost of the strongest mark from here outwards that counts


@dataclass
class Element:
    tag: str
    parent: Element | None
    depth: int
    gain: float  # of the best element from the root on
    main: bool
    mark: Mark | None
    silent: bool
    in_link: bool
    block: Element | None = None  # the nearest block-level or silent element, itself included


@dataclass
class Block:
    element: Element
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""
    words: int = 0


def _attributes(raw: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for m in _ATTR.finditer(raw):  # of repeated names the first counts
        value = m[2] or ""
        found.setdefault(m[1].lower(), unescape(value[1:].removesuffix(value[0]) if value[:1] in ("'", '"') else value))
    return found


def name_says(names: str, in_main: bool) -> int:
    """-1 if a class or id names furniture, 1 if it names content, else 0."""
    bad = good = False
    for name in names.lower().split():
        parts = [p for p in (re.sub(r"\d+", "", x) for x in re.split(r"[_\-:]+", name)) if p]
        if not parts or parts[0] in STATE_WORDS:
            continue
        word = parts[-1] if parts[-1] in BAD_WORDS else parts[0] if parts[0] in BAD_WORDS and all(p in CONTAINER_WORDS or p in BAD_WORDS for p in parts[1:]) else ""
        if word and not (in_main and word in OWN_HEADERS):
            bad = True
        elif parts[-1] in GOOD_WORDS or parts[0] in GOOD_WORDS:
            good = True
    return good - bad


def _open(tag: str, raw: str, parent: Element) -> Element:
    role, says, hidden = "", 0, False
    if raw and not raw.isspace():
        a = _attributes(raw)
        role = a.get("role", "").lower()
        if tag not in ("html", "body"):
            says = name_says(f"{a.get('class', '')} {a.get('id', '')}", parent.main)
        hidden = "hidden" in a or a.get("aria-hidden") == "true" or bool(_HIDDEN.search(a.get("style", "")))
    main = tag in MAIN or role in MAIN
    own = parent.main and (tag == "header" or role == "banner")
    mark = parent.mark
    if role in FURNITURE_ROLES and not own:
        mark = Mark(TAG_COST, False, mark)
    elif tag in FURNITURE_TAGS and not own and not main:
        mark = Mark(TAG_COST, tag == "form", mark)
    elif says < 0:
        mark = Mark(NAME_COST, True, mark)
    if main and mark:
        mark.holds_main = True
    gain = max(parent.gain, MAIN_GAIN if main else GOOD_GAIN if says > 0 else 0.0)
    e = Element(tag, parent, parent.depth + 1, gain, main or parent.main, mark, hidden or tag in SILENT or parent.silent, tag == "a" or parent.in_link)
    e.block = e if tag in BLOCKS or tag in SILENT else parent.block
    return e


def read_blocks(html: str) -> list[Block]:
    """Text blocks in page order, with the element that each lies in."""
    at = root = Element("", None, 0, 0.0, False, None, False, False)
    root.block = root
    out: list[Block] = []
    now: Block | None = None
    opened: Counter[str] = Counter()
    marks: list[Mark] = []

    def add(raw: str) -> None:
        nonlocal now
        if at.silent or not raw:
            return
        text = unescape(raw)
        if now is None:
            if not text.strip():
                return
            now = Block(at.block)
            out.append(now)
        now.parts.append(text)
        now.linked += len(text.split()) if at.in_link else 0

    def leave(last: Element) -> None:
        """Ends all open elements up to ``last``."""
        nonlocal at
        while at is not last.parent:
            opened[at.tag] -= 1
            at = at.parent

    pos, n = 0, len(html)
    while pos < n:
        lt = html.find("<", pos)
        if lt < 0:
            add(html[pos:])
            break
        m = _TOKEN.match(html, lt)
        if m is None:  # a plain < in the text
            add(html[pos : lt + 1])
            pos = lt + 1
            continue
        add(html[pos:lt])
        pos = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if tag in BLOCKS and not at.silent:
            now = None
        elif tag == "br":
            add(" ")
        if m[1]:
            if opened[tag]:  # an end without a beginning ends nothing
                e, shut = at, tag != "p" and tag in BLOCKS
                # a paragraph or an inline element does not end from inside a control, other blocks end what was left open
                while e.tag != tag and (shut or e.tag not in SILENT):
                    e = e.parent
                if e.tag == tag:
                    leave(e)
            continue
        if tag in VOID:
            continue
        while at.tag in CLOSES and tag in CLOSES[at.tag]:
            leave(at)
        if tag in BLOCKS and at.block.tag in CLOSES and tag in CLOSES[at.block.tag]:
            leave(at.block)  # inline elements left open inside a paragraph end with it, but none outside a control
        if m[3].endswith("/") and tag not in BLOCKS and tag not in RAW:
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*[^>]*>", re.I).search(html, pos)
            pos = end.end() if end else n
            continue
        around = at.mark
        at = _open(tag, m[3], at)
        opened[tag] += 1
        if at.mark is not around:
            marks.append(at.mark)
    for b in out:
        b.text = _SPACES.sub(" ", "".join(b.parts)).strip()
        b.words = len(b.text.split())
        if b.element.mark:
            b.element.mark.words += b.words
    for mark in reversed(marks):  # inner ones were made later
        if mark.outer:
            mark.outer.words += mark.words
            mark.outer.holds_main |= mark.holds_main
    return [b for b in out if b.text]


def _against(mark: Mark | None, total: int) -> float:
    """The strongest cost of the marks around a block; a name around half of the page with its main part says nothing."""
    walked, most = [], 0.0
    while mark is not None and mark.least is None:
        walked.append(mark)
        mark = mark.outer
    if mark is not None:
        most = mark.least
    for m in reversed(walked):
        m.least = most = most if m.by_name and m.holds_main and 2 * m.words >= total else min(most, m.cost)
    return most


def content_costs(blocks: list[Block]) -> list[float]:
    """Log odds that each block is content."""
    total = sum(b.words for b in blocks)
    marked = 2 * sum(b.words for b in blocks if b.element.main and b.element.mark is None) >= total
    out = []
    for b in blocks:
        e = b.element
        against = _against(e.mark, total)
        place = against + INSIDE * e.gain if against else e.gain if e.main or not marked else e.gain + OUTSIDE
        text = min(MOST_LENGTH, LENGTH * (log1p(b.words) - 0.6)) + SENTENCE * (b.text[-1:] in ".!?:;\"'”»)")
        out.append(place + LINKED * (b.linked / b.words) + text)
    return out


def _distance(a: Element, b: Element) -> int:
    """Steps between two elements; of neighbouring blocks these are what ended and began between them."""
    steps = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


def _edges(blocks: list[Block]) -> Iterator[tuple[int, int, float]]:
    last: dict[int, int] = {}
    for i, b in enumerate(blocks):
        if i:
            border = blocks[i - 1].element.mark is not b.element.mark
            yield i - 1, i, NEIGHBOUR / (1 + _distance(blocks[i - 1].element, b.element)) * (BORDER if border else 1.0)
        up = id(b.element.parent)
        if up in last and last[up] < i - 1:
            yield last[up], i, SIBLING
        last[up] = i


def minimum_cut(cost: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True for nodes on the source side of a minimum cut.

    A positive cost is the capacity from the source, a negative one to the sink;
    an edge has its capacity both ways.  Shortest augmenting paths in level
    graphs; nodes that only touch the source side of the residual are content.
    """
    n = len(cost)
    source, sink = n, n + 1
    to: list[int] = []
    room: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def join(a: int, b: int, forth: float, back: float) -> None:
        out[a].append(len(to))
        to.append(b)
        room.append(forth)
        out[b].append(len(to))
        to.append(a)
        room.append(back)

    for i, c in enumerate(cost):
        if c > 0:
            join(source, i, c, 0.0)
        elif c < 0:
            join(i, sink, -c, 0.0)
    for a, b, w in edges:
        join(a, b, w, w)
    tiny = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in out[a]:
                if room[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        turn = [0] * (n + 2)
        path: list[int] = []
        a = source
        while True:
            if a == sink:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                k = next(i for i, e in enumerate(path) if room[e] <= tiny)
                a = to[path[k] ^ 1]
                del path[k:]
                continue
            while turn[a] < len(out[a]):
                e = out[a][turn[a]]
                if room[e] > tiny and level[to[e]] == level[a] + 1:
                    break
                turn[a] += 1
            if turn[a] < len(out[a]):
                path.append(out[a][turn[a]])
                a = to[path[-1]]
            elif path:
                a = to[path.pop() ^ 1]
                turn[a] += 1
            else:
                break


def main_text(html: str | None) -> str:
    blocks = read_blocks(html or "")
    if not blocks:
        return ""
    keep = minimum_cut(content_costs(blocks), list(_edges(blocks)))
    return "\n".join(b.text for b, k in zip(blocks, keep) if k)


def extract(pages: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """The columns of ``pages`` but html, then the main text and n_chars."""
    keep = [f for f in pages.schema.fields if f.name not in (html, out, "n_chars")]
    source = pages.select(*[quoted(f.name) for f in keep], quoted(html))
    schema = T.StructType([*keep, T.StructField(out, T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*(f.name for f in keep), out, "n_chars"])

    return map_rows(source, run, schema)
