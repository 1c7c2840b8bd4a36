"""Main text of web pages by tree scoring.

A tolerant parser builds the element tree. Elements that are never article text (navigation, headers and
footers of the page, sidebars, forms, scripts) are left out by tag or role, and those that their class
or id names as an advert, a notice, a menu or reader comments by that name; a name that only has such a
word as a part counts against a container that holds less than half of the page's points, and never
against a paragraph. Each paragraph earns points for its length and its commas and passes them to its
ancestors, less with every level; a container's points are discounted by the share of its text that
stands in links, and article and main count double. The best container is kept, with siblings that score
near it, hold plain prose or head it, and its blocks are given in page order.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievemark.llm.common import no_clash, own_name

# HTML element names by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
DROPPED = frozenset("head nav aside footer form button select input textarea script style noscript iframe object embed svg canvas template dialog menu title audio video map noframes noembed xmp option datalist".split())
ENDS_PARAGRAPH = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section summary table ul".split())
CONTAINERS = frozenset("article main section div body td blockquote html".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
BOXES = frozenset("article aside center details dir div dl fieldset figure footer header hgroup main menu nav ol section table tbody ul".split())
SCOPES = {"li": ("ul", "ol", "menu", "dir"), "dd": ("dl",), "dt": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "option": ("select",)}
ALIKE = {"dd": ("dd", "dt"), "dt": ("dd", "dt"), "td": ("td", "th"), "th": ("td", "th")}
# Words of classes and ids.
AWAY = frozenset("ad ads adv advert adverts advertisement advertising adbox banner sponsor sponsored promo promotion nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar aside widget footer foot header masthead topbar toolbar cookie cookies consent gdpr notice notices alert popup modal overlay subscribe subscription newsletter signup login share sharing social related recommended comments comment commentlist disqus reply replies respond pagination pager pagenav tags taglist skip copyright disclaimer search".split())
COMMENTS = frozenset("comment comments commentlist disqus reply replies respond".split())
HOME = frozenset("article content entry post story body text main blog page column".split())
STORY = frozenset("article entry post story".split())
NEVER_HOME = frozenset("ad ads sidebar nav menu footer header widget share related".split()) | COMMENTS
AWAY_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())

_PART = re.compile(r"<!--|<![^-]|<\?|</?[A-Za-z]")
_TAG = re.compile(r"</?([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]++)(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I | re.A) for tag in RAW}
_SPLIT = re.compile(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])")
_WHITE = re.compile(r"\s+")


#: Nesting beyond which elements no longer open a level, as in browsers; it keeps every walk up the tree short.
DEEPEST = 512


class Node:
    __slots__ = ("tag", "parent", "children", "attributes", "score", "depth")

    def __init__(self, tag: str, parent: Node | None, attributes: str = ""):
        self.tag, self.parent, self.attributes = tag, parent, attributes
        self.depth: int = parent.depth + 1 if parent is not None else 0
        self.children: list[Node | str] = []
        self.score = 0.0


def parse(html: str) -> Node:
    """The element tree; end tags without a start are ignored, elements without an end run as far as HTML lets them."""
    root = node = Node("html", None)
    at, n, flat = 0, len(html), 0

    def close(tags: tuple[str, ...], scope: tuple[str, ...]) -> None:
        nonlocal node
        x = node
        while x.parent is not None and x.tag not in scope:
            if x.tag in tags:
                node = x.parent
                return
            x = x.parent

    while at < n:
        m = _PART.search(html, at)
        if m is None:
            node.children.append(html[at:])
            break
        if m.start() > at:
            node.children.append(html[at : m.start()])
        at = m.start()
        if html.startswith("<!--", at):
            end = html.find("-->", at + 2)
            at = n if end < 0 else end + 3
            continue
        if html[at + 1] in "!?":
            end = html.find(">", at)
            at = n if end < 0 else end + 1
            continue
        t = _TAG.match(html, at)
        if t is None:
            end = html.find(">", at)
            at = n if end < 0 else end + 1
            continue
        at, tag = t.end(), t[1].lower()
        if html[t.start() + 1] == "/":
            if flat and tag not in VOID:
                flat -= 1
            elif tag == "p" or tag not in VOID:
                x = node
                while x is not None and x.tag != tag:
                    x = None if x.parent is None or x.tag in ("table", "td", "th") and tag not in ("table", "tr", "tbody", "thead", "tfoot", "td", "th", "body", "html", "div", "article", "section", "main") else x.parent
                if x is not None and x.parent is not None:
                    node = x.parent
            continue
        if tag == "html":
            root.attributes += t[2]
            continue
        if tag in ENDS_PARAGRAPH:
            close(("p",), ("td", "th", "button", "table"))
        elif tag in SCOPES:
            close(ALIKE.get(tag, (tag,)), SCOPES[tag])
        elif tag == "body":
            close(("head",), ())
        new = Node(tag, node, t[2])
        node.children.append(new)
        if tag in RAW:
            end = _RAW_END[tag].search(html, at)
            if tag not in DROPPED:
                new.children.append(html[at : end.start() if end else n])
            stop = html.find(">", end.end()) if end else -1
            at = n if stop < 0 else stop + 1
        elif tag not in VOID and (tag in BLOCKS or not t[2].endswith("/")):
            if new.depth < DEEPEST:
                node = new
            else:
                flat += 1
    return root


def _named(attributes: str) -> dict[str, str]:
    """Attributes by lower-case name; of a repeated one the first counts."""
    out: dict[str, str] = {}
    for k, a, b, c in _ATTRIBUTE.findall(attributes):
        out.setdefault(k.lower(), unescape(a or b or c))
    return out


def _parts(names: str) -> set[str]:
    return {w.lower() for w in _SPLIT.split(names)} - {""}


def _page_header(node: Node) -> bool:
    """Whether a header is the page's and not an article's: that one has a heading and stands in an article."""
    if not any(isinstance(c, Node) and c.tag in HEADINGS for c in node.children):
        return True
    x = node.parent
    while x is not None:
        if x.tag in ("article", "main") or x.tag in BOXES and x.attributes and _parts(" ".join(_named(x.attributes).get(k, "") for k in ("class", "id"))) & STORY:
            return False
        x = x.parent
    return True


GONE, DOUBTFUL, KEPT = range(3)


def standing(node: Node) -> int:
    """GONE: no article text, with all that the element holds; DOUBTFUL: a container whose name has a word of such elements as a part."""
    if node.tag in DROPPED or node.tag == "header" and _page_header(node):
        return GONE
    if not node.attributes:
        return KEPT
    named = _named(node.attributes)
    if "hidden" in named or named.get("aria-hidden") == "true" or named.get("role", "").lower() in AWAY_ROLES or _HIDDEN.search(named.get("style", "")):
        return GONE
    if node.tag in ("article", "main", "body", "html"):
        return KEPT
    tokens = [t for k in ("class", "id") for t in named.get(k, "").split()]
    whole = [t.lower() in AWAY for t in tokens]
    if node.tag not in BOXES:
        return GONE if whole and all(whole) else KEPT
    parts = [_parts(t) for t in tokens]
    words = set().union(*parts)
    if any(whole) or words & COMMENTS or any(p and p <= AWAY for p in parts):
        return GONE
    return DOUBTFUL if words & AWAY and (not words & HOME or words & NEVER_HOME) else KEPT


class Block:
    __slots__ = ("node", "parts", "linked", "doubts")

    def __init__(self, node: Node, doubts: tuple[Node, ...]):
        self.node, self.parts, self.linked, self.doubts = node, [], 0, doubts

    def text(self) -> str:
        return _WHITE.sub(" ", unescape("".join(self.parts))).strip()


def blocks(root: Node) -> list[tuple[Node, str, int, tuple[Node, ...]]]:
    """(innermost block element, text, characters in links, doubtful containers around it) of each run of text, in page order."""
    out: list[Block] = []
    current: Block | None = None
    stack: list[tuple[Node, Iterator, Node, bool, tuple[Node, ...]]] = [(root, iter(root.children), root, False, ())]
    while stack:
        node, rest, block, linked, doubts = stack[-1]
        child = next(rest, None)
        if child is None:
            stack.pop()
            if node.tag in BLOCKS:
                current = None
            continue
        if isinstance(child, str):
            if current is None or current.node is not block:
                current = Block(block, doubts)
                out.append(current)
            current.parts.append(child)
            current.linked += len(child) * linked
        elif child.tag == "br":
            if current is not None:
                current.parts.append(" ")
        elif (stands := standing(child)) == GONE:
            if child.tag in BLOCKS:
                current = None
        else:
            inner = child if child.tag in BLOCKS else block
            if inner is child:
                current = None
            stack.append((child, iter(child.children), inner, linked or child.tag == "a", (*doubts, child) if stands == DOUBTFUL else doubts))
    return [(b.node, text, b.linked, b.doubts) for b in out if (text := b.text())]


def _ancestors(node: Node) -> Iterator[Node]:
    x: Node | None = node
    while x is not None:
        yield x
        x = x.parent


def points(text: str) -> float:
    """What a paragraph is worth; short ones, such as headings and captions, nothing."""
    return 1 + min(len(text) / 100, 3) + text.count(",") + text.count("，") if len(text) >= 25 else 0.0


def _certain(found: list[tuple[Node, str, int, tuple[Node, ...]]]) -> list[tuple[Node, str, int]]:
    """The blocks without those in a doubtful container that doesn't hold more than half of the page's points."""
    if not any(doubts for *_, doubts in found):
        return [(n, t, k) for n, t, k, _ in found]
    held: dict[Node, float] = {}
    total = 0.0
    for _, text, in_links, doubts in found:
        worth = points(text) * (1 - min(1.0, in_links / len(text)))
        total += worth
        for x in doubts:
            held[x] = held.get(x, 0.0) + worth
    return [(n, t, k) for n, t, k, doubts in found if all(2 * held[x] > total for x in doubts)]


def main_text(html: str) -> str:
    """The article's blocks, joined by an empty line; empty if the page has no text."""
    found = _certain(blocks(parse(html)))
    if not found:
        return ""
    size: dict[Node, int] = {}
    linked: dict[Node, int] = {}
    for node, text, in_links in found:
        for x in _ancestors(node):
            size[x] = size.get(x, 0) + len(text)
            linked[x] = linked.get(x, 0) + min(in_links, len(text))
        if not (worth := points(text)):
            continue
        level = 0
        for x in _ancestors(node.parent if node.tag not in CONTAINERS and node.parent is not None else node):
            if x.tag in CONTAINERS:
                x.score += worth / (1 if level == 0 else 2 if level == 1 else 3 * level)
                level += 1
    density = lambda x: linked.get(x, 0) / max(1, size.get(x, 0))
    for x in size:
        x.score *= (1 - density(x)) * (2 if x.tag in ("article", "main") else 1)
    best = max(size, key=lambda x: (x.score, size[x]))
    if best.score <= 0:  # nothing but short blocks: those of the largest article, if there is one
        told = max((x for x in size if x.tag in ("article", "main") and density(x) < 0.6), key=size.__getitem__, default=None)
        return "\n\n".join(t for n, t, k in found if (k < 0.5 * len(t) if told is None else told in _ancestors(n)))
    while best.parent is not None and best.parent.tag in CONTAINERS and best.parent.score >= best.score:
        best = best.parent
    keep, own = {best}, {n: t for n, t, _ in found}
    if best.parent is not None:
        heads: list[Node] = []
        for x in best.parent.children:
            if x is best:
                keep.update(heads)
            elif isinstance(x, Node) and x in size:
                heads = [*heads, x] if x.tag in HEADINGS else []
                near = x.tag in CONTAINERS and x.score >= max(10, 0.2 * best.score)
                prose = x.tag == "p" and (size[x] > 80 and density(x) < 0.25 or density(x) == 0 and own.get(x, "").endswith((".", "!", "?")))
                if near or prose:
                    keep.add(x)
    return "\n\n".join(t for n, t, _ in found if any(x in keep for x in _ancestors(n)))


def extracted(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ()) -> DataFrame:
    """page_id, the columns named in keep, and text: the main text of each page.

    A null or empty page, and one without text, gives the empty text. Pages are read one by one, whole;
    repeated rows come out each, other columns of any name are left out; keep can't name text or page_id.
    """
    no_clash(keep, ("page_id", "text"))
    at = own_name("html", list(keep))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = pa.array([main_text(h) if h else "" for h in b.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *b.columns[2:], texts], names=[b.schema.names[0], *b.schema.names[2:], "text"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).cast("string").alias(at), *keep)
    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes if n != at) + ", text string"
    return rows.mapInArrow(run, schema)
