"""HTML pages to paragraphs, links and the main text container: the one place where a page crosses into Python.

A page is parsed once, by the tolerant parser of the standard library, and everything that is wanted of it leaves in one
struct. Repair of broken markup is our own: a block start closes an open p; li, dt/dd, td/th, tr and option close their like;
an end tag without a start is dropped; what is open at the end is closed. Other parsers may repair very broken pages otherwise.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = [f"h{i}" for i in range(1, 7)]
BLOCK = {*HEADINGS, *"address article blockquote dd div dl dt figcaption figure header li main ol p pre section table tr ul".split()}
#: What is not prose, by name, class, id, and part of a class or id.
JUNK_NAMES = set("aside audio button canvas footer form iframe input nav noscript picture script select source style svg textarea video".split())
JUNK_CLASSES = set(
    """ad ads advert advertisement bookmark breadcrumb breadcrumbs comment comment-list commentlist comments pager
    pagination paging rating-widget related related-stories report share sharing sidebar similar social vote voting""".split()
)
JUNK_IDS = {"sidebar", "comments"}
JUNK_CLASS_PARTS, JUNK_ID_PARTS = ("adsbygoogle", "banner"), ("taboola", "adsense", "banner")
CONTAINERS = set("article div main section td".split())
#: A start tag of the key ends these, as far up as the barrier.
CLOSES = {k: ({"li"}, {"ul", "ol"}) for k in ["li"]}
CLOSES |= {k: ({"dt", "dd"}, {"dl"}) for k in ("dt", "dd")}
CLOSES |= {k: ({"td", "th"}, {"table", "tr"}) for k in ("td", "th")}
CLOSES |= {"tr": ({"tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"})}
CLOSES_P = BLOCK | {"hr", "aside", "footer", "form", "nav"} - {"tr"}
RUN = re.compile(f"[{''.join(map(chr, (9, 32, 160, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000)))}]+")
MOST_BREAKS = 200
HIDDEN = {"script", "style", "template"}

FIELDS = {
    "title": "string",
    "canonical": "string",
    "paragraphs": "array<string>",
    "fallback": "boolean",
    "container": "struct<pos: int, tag: string, chars: int, density: double, breaks: int, score: double>",
    "links": "array<struct<pos: int, href: string, text: string>>",
    "density": "double",
}
SCHEMA = ", ".join(f"{k} {v}" for k, v in FIELDS.items())
#: Characters of pages that are parsed before what was found goes back to the JVM, and rows; a longer page goes alone.
PIECE, PIECE_ROWS = 2_000_000, 500


class Node:
    __slots__ = ("attrs", "children", "pos", "tag")

    def __init__(self, tag: str, attrs: dict, pos: int):
        self.tag, self.attrs, self.pos, self.children = tag, attrs, pos, []


class Builder(HTMLParser):
    """Elements and texts in document order; comments and declarations are left out."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("", {}, 0)
        self.open = [self.root]
        self.count = 0

    def handle_starttag(self, tag, attrs):
        if tag in CLOSES_P:
            self._close({"p"}, CONTAINERS | {"table", "blockquote"})
        if tag in CLOSES:
            self._close(*CLOSES[tag])
        self.count += 1
        node = Node(tag, {k: v or "" for k, v in reversed(attrs)}, self.count)
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        self.open[-1].children.append(data)

    def _close(self, tags: set[str], barrier: set[str]) -> None:
        at = None
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in tags:
                at = i
            elif self.open[i].tag in barrier:
                break
        if at:
            del self.open[at:]


def tree(html: str) -> Node:
    b = Builder()
    b.feed(html)
    b.close()
    return b.root


def is_junk(n: Node) -> bool:
    if n.tag in JUNK_NAMES:
        return True
    cls, own = n.attrs.get("class", ""), n.attrs.get("id", "")
    return bool(cls and (not JUNK_CLASSES.isdisjoint(cls.split()) or any(x in cls for x in JUNK_CLASS_PARTS)) or own and (own in JUNK_IDS or any(x in own for x in JUNK_ID_PARTS)))


def prose(root: Node) -> str:
    """Text of a node without junk; line ends for br, blank lines about blocks, stars for hr. An explicit stack: pages nest deeply."""
    out: list[str] = []
    stack: list = [iter(root.children)]
    after = [""]
    while stack:
        x = next(stack[-1], None)
        if x is None:
            stack.pop()
            out.append(after.pop())
        elif isinstance(x, str):
            out.append(x)
        elif not is_junk(x):
            edge = "\n\n" if x.tag in BLOCK else ""
            out.append({"br": "\n", "hr": "\n\n* * *\n\n"}.get(x.tag, edge))
            stack.append(iter(x.children))
            after.append(edge)
    return "".join(out)


def paragraphs(text: str) -> list[str]:
    text = re.sub("\r\n?", "\n", text)
    text = text if text.isascii() else unicodedata.normalize("NFC", text)
    found = ([y for x in p.split("\n") if (y := RUN.sub(" ", x).strip())] for p in re.split("\n\n+", text))
    return ["\n".join(x) for x in found if x]


def plain(n: Node) -> str:
    out, stack = [], [n]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
        elif x is n or x.tag not in HIDDEN:
            stack.extend(reversed(x.children))
    return "".join(out)


def inline(text: str) -> str | None:
    composed = text if text.isascii() else unicodedata.normalize("NFC", text)
    return RUN.sub(" ", composed).strip() or None


def measured(root: Node) -> list[tuple]:
    """(node, texts, characters, characters in links, p and br below, longest direct child) in document order, in one pass."""
    order, stack = [], [root]
    while stack:
        x = stack.pop()
        order.append(x)
        stack.extend(c for c in reversed(x.children) if not isinstance(c, str))
    m: dict[int, tuple] = {}
    for n in reversed(order):  # children come before their parents
        texts = chars = linked = breaks = longest = 0
        for c in n.children:
            if isinstance(c, str):
                k = len(c.strip())
                texts, chars = texts + (k > 0), chars + k
                continue
            t, k, a, b, _ = m[id(c)]
            if c.tag not in HIDDEN:
                texts, chars = texts + t, chars + k
            linked += a + (k if c.tag == "a" else 0)
            breaks += b + (c.tag in ("p", "br"))
            if c.tag in ("div", "article", "section"):
                longest = max(longest, k + max(0, t - 1))
        m[id(n)] = texts, chars, linked, breaks, longest
    return [(n, *m[id(n)]) for n in order]


def best_container(nodes: list[tuple], min_chars: int) -> tuple | None:
    best = None
    for n, texts, chars, linked, breaks, longest in nodes:
        length = chars + max(0, texts - 1)
        if n.tag not in CONTAINERS or length < min_chars:
            continue
        density = linked / chars if chars else 1.0
        if density > 0.25 or longest > 0.9 * length:
            continue
        score = length * (1 - density) * (1 + min(breaks, MOST_BREAKS) / MOST_BREAKS)
        if best is None or score > best[-1]:
            best = n, length, density, breaks, score
    return best


def parse(html: str | None, min_chars: int = 400, want: tuple[str, ...] = tuple(FIELDS)) -> dict | None:
    """What is wanted of a page. NULL stays NULL; an empty page has no paragraphs and a density of 1."""
    if html is None:
        return None
    root = tree(html)
    nodes = measured(root)
    _, _, chars, linked, _, _ = nodes[0]
    found: dict = {"density": linked / chars if chars else 1.0}
    if not {"paragraphs", "fallback", "container"}.isdisjoint(want):
        best = best_container(nodes, min_chars)
        found |= {"fallback": best is None, "container": best and {"pos": best[0].pos, "tag": best[0].tag, "chars": best[1], "density": best[2], "breaks": best[3], "score": best[4]}}
        if "paragraphs" in want:
            found["paragraphs"] = paragraphs(prose(best[0] if best else root))
    title = heading = canonical = None
    links = []
    for n, *_ in nodes:
        if n.tag == "a" and "href" in n.attrs:
            if "links" in want:
                links.append({"pos": len(links), "href": n.attrs["href"], "text": inline(plain(n))})
        elif n.tag == "title" and title is None:
            title = inline(plain(n))
        elif n.tag == "h1" and heading is None:
            heading = inline(plain(n))
        elif n.tag == "link" and canonical is None and "canonical" in n.attrs.get("rel", "").lower().split():
            canonical = n.attrs.get("href") or None
    found |= {"title": heading or title, "canonical": canonical, "links": links}
    return {k: found[k] for k in want}


def pieces(pages: pa.Array) -> Iterator[pa.Array]:
    """A batch in slices of PIECE characters or PIECE_ROWS rows, so that memory doesn't follow the rows of a batch."""
    start = size = 0
    for i, n in enumerate(pa.compute.binary_length(pages).to_pylist()):
        if i > start and (size + (n or 0) > PIECE or i - start >= PIECE_ROWS):
            yield pages.slice(start, i - start)
            start, size = i, 0
        size += n or 0
    yield pages.slice(start)


def by_pieces(html: Column, f: Callable, schema: str, kind: pa.DataType) -> Column:
    """f of each page, as a column."""

    @F.arrow_udf(schema)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for piece in pieces(batch):
                yield pa.array([f(x) for x in piece.to_pylist()], kind)

    return run(html)


def parsed_page(html: Column, min_chars: int = 400, want: tuple[str, ...] = tuple(FIELDS)) -> Column:
    """Struct of those FIELDS that are wanted; NULL html gives a struct of NULLs."""
    nothing = dict.fromkeys(want)
    schema = ", ".join(f"{k} {FIELDS[k]}" for k in want)
    return by_pieces(html, lambda x: parse(x, min_chars, want) or nothing, schema, to_arrow_type(StructType.fromDDL(schema)))


def html_paragraphs(html: Column) -> Column:
    """Paragraphs of a whole fragment."""
    return by_pieces(html, lambda x: None if x is None else paragraphs(prose(tree(x))), "array<string>", pa.list_(pa.string()))
