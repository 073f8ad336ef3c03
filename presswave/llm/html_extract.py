"""Main text of web pages by composite text density.

Each page is parsed to a DOM; every node gets its composite text density: characters per tag, adjusted
for link characters and link tags. A node's density sum adds up its children's densities. The node with
the largest sum is found, and the least density on its path to the body is the threshold. From there the
choice climbs the path, below the body, as long as what a parent adds (taken as one node) has ``CLIMB`` of
the threshold: an article in several sections is whole, menus and notes beside it stay out. Elsewhere in
the body the largest-sum subtrees of nodes that reach the threshold are content too. Elements that are
furniture by tag, role or class (menus, adverts, sidebars, comments, forms ...) take no part; a name marks only if all its words
do (``social-share``, not ``social-policy``), and no name or form takes away nearly all text of a page. Formatting
elements (b, span ...) are text of their block, neither tags nor nodes; references count as what they stand for.

Python runs inside tasks on one page at a time (mapInArrow, slices of a bounded number of bytes); there is
no shuffle. Parsing is linear in the page, whatever is left unclosed. Rows: null or empty html gives '' and
0. Rows may repeat. A null url stays null. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from presswave.llm.lookup import slices

#: Share of the threshold that the rest of a parent needs to be taken with its densest child.
CLIMB = 0.25

# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp svg math".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - {"br", "html", "head", "body", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "dd", "dt", "li", "legend", "summary"}
FURNITURE = frozenset(
    "head script style noscript template iframe object embed nav footer aside form button select option input textarea label menu "
    "dialog svg math canvas audio video noembed noframes title".split()
)
FORMATTING = frozenset(
    "abbr acronym b bdi bdo big br cite code data del dfn em font i ins kbd mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr img".split()
)
#: An open element of the first kind ends at a start tag of the second kind.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}}
STOPS = {"article", "section", "div", "body", "table", "blockquote", "aside", "main"}

# Words that mark furniture in class, id and role, and words of place that may stand beside them in one name.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising sponsor sponsored promo promos promotion promotions banner cookie cookies consent gdpr "
    "notice notices alert popup modal overlay nav navigation navbar menu breadcrumb breadcrumbs sidebar side aside footer foot masthead header head topbar toolbar "
    "comment comments disqus replies respond related recommend recommended recommendation recommendations share sharing social subscribe newsletter signup login "
    "search widget pagination pager tags copyright skip contentinfo complementary".split()
)
PLACES = frozenset(
    "area bar block bottom box button buttons center col column container desktop fixed form group inner item items left level link links list main mobile outer page panel "
    "primary right row secondary section site slot space sticky top unit wrap wrapper".split()
)
#: Names of an article's own head.
HEADS = frozenset(("header", "head", "masthead"))
PARTS = re.compile(r"[-_]+")
#: A form or a named element that holds nearly all text of a page is no furniture: what is outside has less than this
#: share of its characters (links do not count), and it has at least so many.
OUTSIDE, AT_LEAST = 0.05, 250
OTHER = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>", re.S)
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*+)")
REST = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
ATTRIBUTE = re.compile(r"([^\s\"'>/=][^\s\"'>/=]*)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>][^\s>]*)))?")
SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("chars", "density", "doubtful", "furniture", "items", "link_chars", "link_tags", "near", "parent", "tag", "tags", "total")

    def __init__(self, tag: str, parent: Node | None, furniture: bool = False, doubtful: bool = False) -> None:
        self.tag, self.parent, self.furniture, self.doubtful, self.items = tag, parent, furniture, doubtful, []
        #: The node itself if a start tag may end it or stop at it, else the next such ancestor.
        self.near = self if parent is None or tag in BLOCK or tag in ENDS else parent.near
        if parent is not None:
            parent.items.append(self)

    def children(self) -> list[Node]:
        return [c for c in self.items if isinstance(c, Node) and not c.furniture]


def marked(value: str, inside_article: bool) -> bool:
    """Whether one of the names in a class, id or role is made of words of furniture and of place alone."""
    for name in value.lower().split():
        parts = [x for x in PARTS.split(name) if x]
        marks = MARKS.intersection(parts) - (HEADS if inside_article else frozenset())
        if marks and all(x in MARKS or x in PLACES for x in parts):
            return True
    return False


def furniture(tag: str, attributes: str, inside_article: bool) -> tuple[bool, bool]:
    """Whether an element is no part of an article, and whether its content may overrule that.

    An article's own header holds its title and stays.
    """
    if tag in FURNITURE or tag == "header" and not inside_article:
        return True, tag == "form"
    doubtful = False
    for name, *values in ATTRIBUTE.findall(attributes):  # from the left, so that values are never names
        name, value = name.lower(), next(filter(None, values), "")
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            return True, False
        if name in ("class", "id", "role") and tag not in ("html", "body", "article", "main") and not (inside_article and tag == "header"):
            doubtful = doubtful or marked(value, inside_article)
    return doubtful, doubtful


def release(root: Node) -> None:
    """Take back doubtful furniture that holds nearly all text of the page, from the outside in."""
    order, stack = [], [root]
    while stack:
        x = stack.pop()
        if not x.furniture or x.doubtful:
            order.append(x)
            stack += [c for c in x.items if isinstance(c, Node)]
    for x in reversed(order):  # all characters, and those that no furniture holds
        own = 0 if x.tag == "a" else sum(len(c.strip()) for c in x.items if isinstance(c, str))
        inside = [c for c in x.items if isinstance(c, Node) and (not c.furniture or c.doubtful)]
        x.chars = own + (0 if x.tag == "a" else sum(c.chars for c in inside))
        x.tags = own + (0 if x.tag == "a" else sum(c.tags for c in inside if not c.furniture))
    seen = root.tags

    def outermost(x: Node) -> list[Node]:
        found, stack = [], [c for c in x.items if isinstance(c, Node)]
        while stack:
            c = stack.pop()
            if not c.furniture:
                stack += [d for d in c.items if isinstance(d, Node)]
            elif c.doubtful:
                found.append(c)
        return found

    doubtful = outermost(root)
    while doubtful:
        most = max(doubtful, key=lambda x: x.chars)
        if most.chars < AT_LEAST or seen >= OUTSIDE * most.chars:
            break
        most.furniture = False
        seen += most.tags
        doubtful = outermost(most)


def tokens(page: str) -> Iterator[tuple[str, str, str, int]]:
    """(kind, name or text, attributes, end) of each text, start and end tag. One scan: a tag with unpaired
    quotes ends at the next '>', and quotes are not looked at from there on.
    """
    at, n, paired, last = 0, len(page), True, page.rfind(">")
    while at < n:
        begin = page.find("<", at)
        if begin < 0 or begin > last and not page.startswith(("<!--", "<![CDATA["), begin):
            break
        name = NAME.match(page, begin)
        other = None if name else OTHER.match(page, begin)
        if not name and not other:
            yield "text", page[at : begin + 1], "", begin + 1
            at = begin + 1
            continue
        if begin > at:
            yield "text", page[at:begin], "", begin
        if other:
            at = other.end()
            if other[0].startswith("<![CDATA["):
                yield "text", other[0][9:].removesuffix("]]>").replace("&", "&amp;"), "", at
            continue
        rest = REST.match(page, name.end()) if paired else None
        end = rest.end() if rest else page.find(">", name.end()) + 1
        if not end:  # no tag ends from here on
            at = begin
            break
        paired = paired and rest is not None
        jump = yield "end" if page[begin + 1] == "/" else "start", name[1].lower(), page[name.end() : end - 1], end
        at = jump or end
    if at < n:
        yield "text", page[at:], "", n


def parse(page: str) -> Node:
    """A forgiving DOM: unclosed paragraphs and list items end where the standard ends them."""
    root = Node("html", None)
    at, opened, raw = root, Counter(), {}
    stream, jump = tokens(page), None
    while True:
        try:
            kind, tag, attributes, end = stream.send(jump)
        except StopIteration:
            return root
        jump = None
        if kind == "text":
            at.items.append(entities.unescape(tag) if "&" in tag else tag)
            continue
        if kind == "end":
            if opened[tag]:
                while at.tag != tag:
                    opened[at.tag] -= 1
                    at = at.parent
                opened[tag] -= 1
                at = at.parent
            elif tag == "p":
                Node("p", at)
            continue
        if tag in ("html", "body"):
            continue
        wanted = {k for k, v in ENDS.items() if tag in v and opened[k]} | ({"p"} if tag in CLOSES_P and opened["p"] else set())
        if wanted:
            stop, x = SCOPE.get(tag, set()) | STOPS - wanted, at.near
            while x.parent is not None and x.tag not in wanted and x.tag not in stop:
                x = x.parent.near
            if x.parent is not None and x.tag in wanted:
                while at is not x.parent:
                    opened[at.tag] -= 1
                    at = at.parent
        node = Node(tag, at, *furniture(tag, attributes, opened["article"] + opened["main"] > 0))
        if tag in VOID or attributes.rstrip().endswith("/") and tag not in BLOCK:
            continue
        if tag in RAW:
            # a name that is never closed again is not looked for again
            close = None if raw.get(tag) == "open" else re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, end)
            if close is None:
                raw[tag] = "open"
                if tag not in ("script", "style"):
                    continue
            if not node.furniture:
                node.items.append(page[end : close.start() if close else len(page)])
            jump = close.end() if close else len(page)
            continue
        opened[tag] += 1
        at = node


def density(chars: int, tags: int, link_chars: int, link_tags: int, ratio: float) -> float:
    """Composite text density; ``ratio`` is the share of link characters in the body."""
    if chars <= 0:
        return 0.0
    tags = max(1, tags)
    base = math.log(chars * link_chars / max(1, chars - link_chars) + ratio * chars + math.e)
    return chars / tags * math.log(max(1.0, chars * tags / (max(1, link_chars) * max(1, link_tags))) + 1) / max(base, 1.0)


def measure(root: Node) -> tuple[list[Node], float]:
    """Set every node's counts, density and density sum; the nodes, children before parents, and the link ratio."""
    order, stack = [], [root]
    while stack:
        x = stack.pop()
        if not x.furniture:
            order.append(x)
            stack += [c for c in x.items if isinstance(c, Node)]
    order.reverse()
    for x in order:
        x.chars = sum(len(SPACE.sub(" ", c.strip())) for c in x.items if isinstance(c, str))
        x.tags = x.link_chars = x.link_tags = 0
        for c in x.children():
            x.chars += c.chars
            x.tags += c.tags + (c.tag not in FORMATTING)
            x.link_chars += c.link_chars
            x.link_tags += c.link_tags
        if x.tag == "a":
            x.link_chars, x.link_tags = x.chars, x.link_tags + 1
    ratio = root.link_chars / max(1, root.chars)
    for x in order:
        x.density = density(x.chars, x.tags, x.link_chars, x.link_tags, ratio)
    for x in order:
        x.total = sum(c.density for c in x.children() if c.tag not in FORMATTING) or x.density
    return order, ratio


def content(root: Node) -> list[Node]:
    """The content subtrees in page order."""
    release(root)
    order, ratio = measure(root)
    peak: dict[Node, Node] = {}
    for x in order:
        peak[x] = max([x, *(peak[c] for c in x.children() if c.tag not in FORMATTING)], key=lambda y: y.total)
    best, path = peak[root], [peak[root]]
    while path[-1].parent is not None:
        path.append(path[-1].parent)
    threshold = min(x.density for x in path)
    for x, up in zip(path, path[1:], strict=False):
        if up is root:
            break
        rest = density(up.chars - x.chars, up.tags - x.tags - 1, up.link_chars - x.link_chars, up.link_tags - x.link_tags, ratio)
        if up.chars > x.chars and rest < CLIMB * threshold:
            break
        best = up
    marked, above, stack = {best}, set(path[path.index(best) :]), [root]
    while stack:
        x = stack.pop()
        if x not in marked and x not in above and x.density >= threshold:
            marked.add(peak[x])
        if x not in marked:
            stack += [c for c in x.children() if c.chars and c.tag not in FORMATTING]
    found, stack = [], [root]
    while stack:
        x = stack.pop()
        if x in marked:
            found.append(x)
        else:
            stack += reversed(x.children())
    return found


def text_of(node: Node) -> str:
    """The blocks of a subtree in page order, white space folded, joined by line feeds."""
    blocks, current = [], []

    def flush() -> None:
        line = SPACE.sub(" ", "".join(current)).strip()
        if line:
            blocks.append(line)
        current.clear()

    stack: list = [node]
    while stack:
        x = stack.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            current.append(x)
        elif not x.furniture:
            if x.tag in BLOCK:
                flush()
                stack.append(None)
            stack += reversed(x.items)
    flush()
    return "\n".join(blocks)


def extract(page: str | None) -> str:
    return "\n".join(filter(None, map(text_of, content(parse(page))))) if page else ""


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "html"):
            texts = [extract(x) for x in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
