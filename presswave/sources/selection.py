"""Elements of stored pages by selectors, and the cells of their tables.

A page is read once by the standard library's parser into a small tree, inside the task that holds it. Selectors
are tags, classes, ids and attributes, combined by descent and ``>``; tables keep rows and cells of nested tables apart.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

# Elements without content, and those that a new one of the second kind ends, up to the third kind.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "tbody": ({"tr", "td", "th", "thead", "tbody"}, {"table"}), "tfoot": ({"tr", "td", "th", "thead", "tbody"}, {"table"}), "p": ({"p"}, {"div", "td", "th", "li", "section", "article", "body"}),
}
#: Texts of these are no text of a page.
SILENT = frozenset(("script", "style", "template"))
#: Most bytes of pages that are read to trees before their rows go on.
BATCH = 1 << 20


class Element:
    __slots__ = ("attributes", "items", "parent", "tag")

    def __init__(self, tag: str, attributes: dict[str, str], parent: Element | None) -> None:
        self.tag, self.attributes, self.parent, self.items = tag, attributes, parent, []

    def below(self, stop: frozenset[str] = frozenset()) -> Iterator[Element]:
        """The elements inside in page order; those named in ``stop`` come, but nothing inside them."""
        stack = [x for x in reversed(self.items) if isinstance(x, Element)]
        while stack:
            x = stack.pop()
            yield x
            if x.tag not in stop:
                stack += [c for c in reversed(x.items) if isinstance(c, Element)]

    def text(self, without: frozenset[str] = SILENT) -> str:
        """The text inside with white space folded, without that of elements named in ``without``."""
        out, stack = [], list(reversed(self.items))
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                out.append(x)
            elif x.tag not in without:
                out.append(" " if x.tag in ("br", "p", "div", "li") else "")
                stack += reversed(x.items)
        return " ".join("".join(out).split())


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.root = self.at = Element("", {}, None)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        ends, stops = ENDS.get(tag, ((), ()))
        x, last = self.at, None
        while ends and x.parent is not None and x.tag not in stops:
            last = x if x.tag in ends else last
            x = x.parent
        if last is not None:
            self.at = last.parent
        made = Element(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.items.append(made)
        if tag not in VOID:
            self.at = made

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.at.items.append(Element(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag: str) -> None:
        x = self.at
        # the end of a row or list does not reach out of its table
        while x.parent is not None and x.tag != tag and not (x.tag == "table" and tag in ENDS):
            x = x.parent
        if x.parent is not None and x.tag == tag:
            self.at = x.parent

    def handle_data(self, data: str) -> None:
        self.at.items.append(data)


def read_page(page: str | None) -> Element:
    reader = _Reader()
    reader.feed(page or "")
    reader.close()
    return reader.root


STEP = re.compile(r"\s*(>)?\s*([a-zA-Z][\w-]*|\*)?((?:[.#][\w-]+|\[[\w-]+(?:[~^$*]?=(?:\"[^\"]*\"|'[^']*'|[^\]]*))?\])*)")
PART = re.compile(r"([.#])([\w-]+)|\[([\w-]+)(?:([~^$*]?=)(?:\"([^\"]*)\"|'([^']*)'|([^\]]*)))?\]")


def parse_selector(selector: str) -> list[list[tuple[bool, str, list[tuple[str, str, str]]]]]:
    """Alternatives of steps from right to left: (whether the step above is the parent, tag, conditions)."""
    out = []
    for one in selector.split(","):
        steps, at, one = [], 0, one.strip()
        while at < len(one):
            m = STEP.match(one, at)
            if not m or m.end() == at or not (m[2] or m[3]):
                raise ValueError(f"cannot read the selector {selector!r}")
            conditions = [("class" if p[1] == "." else "id", "~=" if p[1] == "." else "=", p[2]) if p[1] else (p[3], p[4] or "", p[5] or p[6] or p[7] or "") for p in PART.finditer(m[3])]
            steps.append((bool(m[1]), (m[2] or "*").lower(), conditions))
            at = m.end()
        if not steps:
            raise ValueError(f"cannot read the selector {selector!r}")
        # a step's flag says how it hangs on the one before: seen from the right it belongs to that one
        out.append(steps[::-1])
    return out


TESTS = {"": lambda have, want: True, "=": str.__eq__, "~=": lambda have, want: want in have.split(), "^=": str.startswith, "$=": str.endswith, "*=": str.__contains__}


def _fits(x: Element, step: tuple) -> bool:
    _, tag, conditions = step
    return x.tag not in ("",) and tag in ("*", x.tag) and all(name in x.attributes and TESTS[how](x.attributes[name], want) for name, how, want in conditions)


def matches(x: Element, steps: list[tuple]) -> bool:
    """Whether the element fits the steps from right to left."""
    if not _fits(x, steps[0]):
        return False
    at = {id(x): x}
    for (direct, *_), step in zip(steps, steps[1:], strict=False):
        above: dict[int, Element] = {}
        for y in at.values():
            y = y.parent
            while y is not None:
                if _fits(y, step):
                    above[id(y)] = y
                if direct:
                    break
                y = y.parent
        if not above:
            return False
        at = above
    return True


def select(root: Element, selector: list) -> list[Element]:
    """The elements that fit, in page order."""
    return [x for x in root.below() if any(matches(x, steps) for steps in selector)]


def links_of(root: Element, selector: list) -> list[tuple[str, str]]:
    """Address and text of the first link of each element that fits (or of the element itself, if it is a link)."""
    out = []
    for x in select(root, selector):
        link = x if x.tag == "a" and "href" in x.attributes else next((y for y in x.below() if y.tag == "a" and "href" in y.attributes), None)
        if link is not None:
            out.append((link.attributes["href"], link.text()))
    return out


def tables_of(root: Element) -> list[list[list[tuple[str, str | None, bool]]]]:
    """The tables of a page in page order: rows of (text, text of the first link, whether it is a header), without nested tables' rows and texts."""
    inner, out = frozenset(("table",)), []
    for table in (x for x in root.below() if x.tag == "table"):
        rows = []
        for tr in (x for x in table.below(inner) if x.tag == "tr"):
            cells = [x for x in tr.below(inner) if x.tag in ("td", "th")]
            links = [next((y for y in x.below(inner) if y.tag == "a"), None) for x in cells]
            rows.append([(x.text(SILENT | inner), link.text() if link is not None else None, x.tag == "th") for x, link in zip(cells, links, strict=True)])
        out.append([r for r in rows if r])
    return out


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[Element]]]:
    """Slices of the batches with about ``BATCH`` bytes of pages, and their trees."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()
        begin, total = 0, 0
        for k, size in enumerate([*sizes, None]):
            if size is None or total + size > BATCH and k > begin:
                if k > begin:
                    part = batch.slice(begin, k - begin)
                    yield part, [read_page(x) for x in part.column(1).to_pylist()]
                begin, total = k, 0
            total += size or 0


def selected_links(pages: DataFrame, key: str, html: str, selector: str) -> DataFrame:
    """key, pos (from 0), link, title: the first link of each element that fits ``selector``, in page order."""
    steps = parse_selector(selector)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, roots in _pages(batches):
            rows = [(k, n, *found) for k, root in enumerate(roots) for n, found in enumerate(links_of(root, steps))]
            at, pos, link, title = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at, pa.int64())), pa.array(pos, pa.int32()), pa.array(link, pa.string()), pa.array(title, pa.string())], [key, "pos", "link", "title"])

    return pages.select(key, html).mapInArrow(run, f"{key} {pages.schema[key].dataType.simpleString()}, pos int, link string, title string")


def table_cells(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, nth (table of the page, from 0), pos (row of it), cells: array of (text, link, head)."""
    cell = pa.list_(pa.struct([("text", pa.string()), ("link", pa.string()), ("head", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, roots in _pages(batches):
            rows = [(k, n, p, [{"text": t, "link": a, "head": h} for t, a, h in row]) for k, root in enumerate(roots) for n, table in enumerate(tables_of(root)) for p, row in enumerate(table)]
            at, nth, pos, cells = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at, pa.int64())), pa.array(nth, pa.int32()), pa.array(pos, pa.int32()), pa.array(cells, cell)], [key, "nth", "pos", "cells"])

    return pages.select(key, html).mapInArrow(run, f"{key} {pages.schema[key].dataType.simpleString()}, nth int, pos int, cells array<struct<text:string,link:string,head:boolean>>")
