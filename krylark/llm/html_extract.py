"""Main text of web pages by tag-path ratios.

A page becomes blocks of text, each with the path of block elements from the root to it; what is inside links is counted
apart.  Per path, text length and punctuation are summed and divided by its blocks; both ratios are smoothed over the
paths in page order and fused; paths whose fused weight reaches the threshold mark content blocks.  Those are the output,
with the gaps between them closed: inside the element that directly holds content blocks, what stands between the first
and the last of them counts too, and so do headings and sentences next to them.  ``article`` and ``main`` are a hint: one
that is mostly content blocks is taken to its ends, so no short paragraph of an article is lost.  Elements that say what
they are (menus, footers, adverts, forms, comments ...) and what consists of links alone never count.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column_type, map_arrow

#: Elements by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe object textarea title svg math canvas audio video noembed noframes xmp".split())
LEFT_OUT = frozenset("head nav header footer aside form button select option datalist dialog menu label fieldset input".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark nobr q ruby rb rp rt rtc s samp small span strike strong sub sup time tt u var wbr".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form toolbar".split())
#: Words in class and id that tell what is not the article.
WORDS = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead footer sidebar "
    "cookie cookies consent gdpr notice notices notification alert popup modal overlay comment comments commentlist disqus respond reply replies discussion related recommended share sharing social subscribe newsletter signup widget toolbar".split()
)
#: Words that may stand beside one of those in the name of such a container.
BESIDE = frozenset("area bar block body bottom bottombar box button buttons col column container content count feed form global group head holder icons inner item items layer left links list main nav outer page pane panel post posts primary reader right row secondary section site slot small sticky sub text top topbar unit user wide wrap wrapper zone".split())
#: Elements that hold blocks; a class of several words is looked at in these only.
HOLDERS = frozenset("#root html body div section article main td th center blockquote table ul ol dl figure details aside iframe span".split())
#: Elements whose own content blocks are read as one run.
CONTAINERS = HOLDERS - frozenset("blockquote table ul ol dl figure details span".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A ``p`` or list item ends where one of these begins.
CLOSES = {"p": frozenset({"p"}), "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "tr": frozenset({"tr", "td", "th"}), "td": frozenset({"td", "th"}), "th": frozenset({"td", "th"})}
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SCOPE = frozenset("ul ol dl table article section div main body html td th blockquote aside nav header footer form".split())

MARKUP = re.compile(r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>[^>\"']+|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
TELLING = re.compile("class|id|role|hidden|style", re.I)
UNENDED = re.compile(r"<[!?].*", re.S)
PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？]")
TOKENS = re.compile(r"[A-Za-z][a-z]*")


def _says_unwanted(token: str, holder: bool) -> bool:
    """Whether a class or id is a word for what is not the article, alone or, on an element that holds blocks, among such words."""
    if token in WORDS:
        return True
    parts = TOKENS.findall(token)
    return holder and not WORDS.isdisjoint(parts) and all(p in WORDS or p in BESIDE or len(p) < 3 for p in parts)


def _unwanted(tag: str, attributes: str) -> bool:
    if tag in LEFT_OUT:
        return True
    if not attributes or tag in ("html", "body", "main", "article") or not TELLING.search(attributes):
        return False
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" and value != "until-found" or name == "aria-hidden" and value == "true" or name == "role" and value in ROLES:
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
        if name in ("class", "id") and any(_says_unwanted(t, tag in HOLDERS) for t in value.split()):
            return True
    return False


class Block:
    """Text between two block tags: its parts, element and path, its characters without white space at the ends, and those in links."""

    __slots__ = ("parts", "element", "path", "chars", "linked", "marks")

    def __init__(self, element: int, path: int):
        self.parts: list[str] = []
        self.element, self.path = element, path
        self.chars = self.linked = self.marks = 0

    def text(self) -> str:
        return " ".join(unescape("".join(self.parts)).split())


class _Page:
    """Elements, in page order, and blocks of text; linear in the page, however deep."""

    def __init__(self, html: str):
        self.tag, self.parent = ["#root"], [0]
        self.container, self.hint = [0], [-1]  # of an element: the nearest that reads as one run, the nearest article or main
        self.blocks: list[Block] = []
        paths: dict[tuple[int, str], int] = {}
        stack, path, at = [0], [-1], 0
        off, opened = [False], {"#root": 1}
        hidden = links = 0
        current: Block | None = None

        def pop(to: int) -> None:
            nonlocal hidden, links
            while len(stack) > to:
                tag = self.tag[stack.pop()]
                path.pop()
                hidden -= off.pop()
                opened[tag] -= 1
                links -= tag == "a"

        def close(tags: frozenset, until: frozenset | None, through: bool) -> None:
            if not any(opened.get(t) for t in tags):
                return
            for k in range(len(stack) - 1, 0, -1):
                name = self.tag[stack[k]]
                if name in tags:
                    pop(k)
                    return
                if until is None and through and name not in INLINE or until is not None and name in until and not (through and name in ("td", "th")):
                    return

        end, last = len(html), html.rfind(">")
        while at < end:
            m = MARKUP.search(html, at) if at <= last else UNENDED.search(html, at)  # no tag can end any more
            if m and not m.re.groups:
                end = m.start()
                m = None
            stop = m.start() if m else end
            if stop > at and not hidden:
                piece = html[at:stop]
                if current is None:
                    k = len(stack) - 1
                    while k and self.tag[stack[k]] in INLINE:
                        k -= 1
                    current = Block(stack[k], path[k])
                    self.blocks.append(current)
                current.parts.append(piece)
                n = len(piece) if links or current.linked else len(piece.strip())
                current.chars += n
                current.marks += len(PUNCTUATION.findall(piece))
                if links:
                    current.linked += len(piece.strip())
            if not m:
                break
            at = m.end()
            closing, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
            if not tag:
                continue
            tag = tag.lower()
            if tag not in INLINE:
                current = None
            if closing:
                close(frozenset((tag,)), None, tag in INLINE)
                continue
            ends = CLOSES.get(tag) or (CLOSES["p"] if tag in ENDS_P else None)
            if ends:
                close(ends, SCOPE, tag == "tr")
            if tag in VOID:
                continue
            if tag in RAW:
                if not attributes.endswith("/"):
                    shut = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
                    at = shut.end() if shut else end
                continue
            self.parent.append(stack[-1])
            e = len(self.tag)
            self.tag.append(tag)
            self.container.append(e if tag in CONTAINERS else self.container[stack[-1]])
            self.hint.append(e if tag in ("article", "main") else self.hint[stack[-1]])
            stack.append(e)
            # a path has block elements only
            path.append(path[-1] if tag in INLINE else paths.setdefault((path[-1], tag), len(paths)))
            opened[tag] = opened.get(tag, 0) + 1
            links += tag == "a"
            bad = _unwanted(tag, attributes)
            off.append(bad)
            hidden += bad


def _smoothed(x: np.ndarray) -> np.ndarray:
    if len(x) < 3:
        return x
    wide = np.concatenate([x[:1], x, x[-1:]])
    return (wide[:-2] + 2 * wide[1:-1] + wide[2:]) / 4


def content_paths(blocks: list[tuple[int, int, int]]) -> set[int]:
    """The paths that reach the threshold, of blocks as (path, characters outside links, punctuation marks)."""
    order: dict[int, int] = {}
    for path, _, _ in blocks:
        order.setdefault(path, len(order))
    chars, marks, count = np.zeros(len(order)), np.zeros(len(order)), np.zeros(len(order))
    for path, c, p in blocks:
        k = order[path]
        chars[k], marks[k], count[k] = chars[k] + c, marks[k] + p, count[k] + 1
    if not chars.any():
        return set()
    fused = np.sqrt(_smoothed(chars / count)) * (1 + _smoothed(marks / count)) * chars
    return {path for path, k in order.items() if chars[k] and fused[k] >= min(fused.std(), fused.max())}


def extract(html: str) -> str:
    """The article's text; empty if there is none."""
    page = _Page(html)
    blocks = [b for b in page.blocks if b.chars and not all(x.isspace() for x in b.parts)]
    free = [max(b.chars - b.linked, 0) if b.linked else b.chars for b in blocks]
    chosen = content_paths([(b.path, f, b.marks) for b, f in zip(blocks, free)])
    content = [b.path in chosen and f > 0 for b, f in zip(blocks, free)]
    if not any(content):
        return ""
    # what every article or main has, and how much of it is content
    held: dict[int, list[int]] = {}
    runs: dict[int, list[int]] = {}
    for k, b in enumerate(blocks):
        h = page.hint[b.element]
        if h >= 0:
            of = held.setdefault(h, [0, 0])
            of[0] += b.chars
            of[1] += b.chars if content[k] else 0
        if content[k]:
            run = runs.setdefault(page.container[b.element], [k, k])
            run[1] = k
    whole = {h for h, (total, good) in held.items() if 2 * good >= total}
    # first and last block below every element: children come after their parents
    first, last = [len(blocks)] * len(page.tag), [-1] * len(page.tag)
    for k, b in enumerate(blocks):
        first[b.element], last[b.element] = min(first[b.element], k), max(last[b.element], k)
    for e in range(len(page.tag) - 1, 0, -1):
        up = page.parent[e]
        first[up], last[up] = min(first[up], first[e]), max(last[up], last[e])

    def near(k: int) -> bool:
        """A heading, or a sentence that is mostly no link."""
        b = blocks[k]
        return 2 * b.linked < b.chars and (page.tag[b.element] in HEADINGS or b.marks > 0)

    taken = [c or page.hint[b.element] in whole for b, c in zip(blocks, content)]
    for e, (lo, hi) in runs.items():
        while lo > first[e] and near(lo - 1):
            lo -= 1
        while hi < last[e] and near(hi + 1):
            hi += 1
        # of what is between, only links in a row are no part of the text
        for k in range(lo, hi + 1):
            taken[k] = taken[k] or free[k] > 0 or not (free[max(k - 1, 0)] == 0 or free[min(k + 1, len(free) - 1)] == 0)
    return " ".join(x for x in (b.text() for b, t in zip(blocks, taken) if t) if x)


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: id, url, text and n_chars.

    A null or empty page, or one without an article, has an empty text; ids may be null or repeated; other columns
    are ignored; a page is parsed whole, whatever its length.
    """
    schema = T.StructType([T.StructField("id", column_type(pages, id_col)), T.StructField("url", T.StringType()), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                got = [extract(x) if x else "" for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1).cast(pa.string()), pa.array(got, pa.string()), pa.array([len(x) for x in got], pa.int64())], names=schema.names)

    return map_arrow(pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")), run, schema).withColumnRenamed("id", id_col)
