"""Rows from stored feeds, pages, JSON and CSV texts.

Everything works on a column of texts, so fetching is somebody else's work and a corpus of any size is one
scan. XML, JSON and CSV use built-in functions; HTML lists and tables use the standard library's parser inside tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswave.functions import text as T
from presswave.sources.selection import table_cells

ITEM = "array<struct<title: string, link: string, pubDate: string, date: string>>"
FEED = f"channel struct<item: {ITEM}>, item {ITEM}, entry array<struct<title: string, link: array<struct<_href: string, _rel: string>>, published: string, updated: string>>, url array<struct<loc: string, lastmod: string>>"


def feed_items(feeds: DataFrame, key: str, xml: str) -> DataFrame:
    """key, title, link, published of the items of RSS (1.0 and 2.0), Atom and sitemap texts; a text that does not parse has none.

    Of an Atom entry's links the first page (rel alternate or none) counts, else the first link.
    """
    f = F.from_xml(F.regexp_replace(xml, r"<(/?)dc:date\b", "<$1date"), FEED)
    one = lambda items, title, link, at: F.transform(items, lambda i: F.struct(title(i).alias("title"), link(i).alias("link"), at(i).alias("published")))
    none = F.lit(None).cast("string")
    page = lambda links: F.coalesce(F.get(F.filter(links, lambda x: x["_rel"].isNull() | (x["_rel"] == "alternate")), 0), F.get(links, 0))["_href"]
    every = F.coalesce(
        one(F.col("f.channel.item"), lambda i: i["title"], lambda i: i["link"], lambda i: F.coalesce(i["pubDate"], i["date"])),
        one(F.col("f.item"), lambda i: i["title"], lambda i: i["link"], lambda i: F.coalesce(i["date"], i["pubDate"])),
        one(F.col("f.entry"), lambda i: i["title"], lambda i: page(i["link"]), lambda i: F.coalesce(i["updated"], i["published"])),
        one(F.col("f.url"), lambda i: none, lambda i: i["loc"], lambda i: i["lastmod"]),
    )
    return feeds.select(key, f.alias("f")).select(key, F.explode(every).alias("i")).select(key, "i.title", "i.link", "i.published")


class _Links(HTMLParser):
    """The links inside elements of one name, in order, with their text."""

    LISTS = frozenset(("ul", "ol", "dl", "table"))

    def __init__(self, item: str) -> None:
        super().__init__()
        self.item, self.depth, self.outer, self.found, self.href, self.text = item, 0, [], [], None, []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in self.LISTS:
            self.outer.append(self.depth)
        self.depth += tag == self.item
        if tag == "a" and self.depth and self.href is None:
            self.href, self.text = dict(attrs).get("href"), []

    def handle_endtag(self, tag: str) -> None:
        if tag == "a" and self.href is not None:
            self.found.append((self.href, " ".join("".join(self.text).split())))
            self.href = None
        if tag in self.LISTS and self.outer:
            self.depth = self.outer.pop()  # items that were not closed end with their list
        self.depth = max(0, self.depth - (tag == self.item))

    def handle_data(self, data: str) -> None:
        if self.href is not None:
            self.text.append(data)


def html_links(pages: DataFrame, key: str, html: str, item: str = "li") -> DataFrame:
    """key, pos (from 0), link, title for the links inside ``item`` elements of each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, page in enumerate(batch.column(1).to_pylist()):
                parser = _Links(item)
                parser.feed(page or "")
                rows += [(k, n, link, title) for n, (link, title) in enumerate(parser.found)]
            at, pos, link, title = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(pos, pa.int32()), pa.array(link, pa.string()), pa.array(title, pa.string())], [key, "pos", "link", "title"])

    return pages.select(key, html).mapInArrow(run, f"{key} {pages.schema[key].dataType.simpleString()}, pos int, link string, title string")


def json_items(rows: DataFrame, key: str, text: str, items: str, fields: dict[str, str]) -> DataFrame:
    """key, pos and one string column for each field: dot paths below each element of the array at the dot path ``items``."""
    listed = F.from_json(F.get_json_object(text, f"$.{items}"), "array<string>")
    each = rows.select(key, F.posexplode(listed).alias("pos", "item"))
    return each.select(key, "pos", *(F.get_json_object("item", f"$.{path}").alias(name) for name, path in fields.items()))


def header_position(texts: Column, wanted: str | tuple[str, ...]) -> Column:
    """The place of a header, from 1; null without one.

    Words: the first header that holds all of them. A text: the header that is it but for case, else the first (not empty) one that
    holds it or that it holds.
    """
    lowered = F.transform(texts, lambda c: F.lower(F.trim(c)))
    first = lambda test: F.array_min(F.transform(lowered, lambda c, i: F.when(test(c), i + 1)))
    if not isinstance(wanted, str):
        return first(lambda c: F.forall(F.array(*map(F.lit, wanted)), lambda w: F.contains(c, w)))
    want = F.lit(wanted.strip().lower())
    return F.coalesce(first(lambda c: c == want), first(lambda c: (c != "") & (F.contains(c, want) | F.contains(want, c))))


def table_values(
    pages: DataFrame, key: str, html: str, name: str | tuple[str, ...] | None, value: str | tuple[str, ...], other: str | tuple[str, ...] | None = None, derive: str = "a", nth: int | None = None
) -> DataFrame:
    """key, name, value of the rows of one table of each page: columns found by their headers, cells as numbers.

    The table is the ``nth`` of the page (from 0), or the first whose headers have the columns; its header is its first row with
    header cells, else its first row. A name is the text of its cell's first link, else of the cell; without ``name`` it is the first
    cell with a letter. ``derive`` is an expression over a (the ``value`` column) and b (the ``other`` column), such as
    ``a - b`` or ``try_divide(a, b)``. Rows without a name or a value are left out.
    """
    rows = table_cells(pages, key, html)
    plain = ~F.exists("cells", lambda c: c["head"])
    heads = rows.groupBy(key, "nth").agg(F.min(F.struct(plain.alias("plain"), F.col("pos").alias("pos"), "cells")).alias("h"))
    texts = F.transform("h.cells", lambda c: c["text"])
    found = heads.select(
        F.col(key).alias("__key"), F.col("nth").alias("__nth"), F.col("h.pos").alias("__head"), (header_position(texts, name) if name else F.lit(0)).alias("n"), header_position(texts, value).alias("va"), header_position(texts, other or value).alias("vb")
    ).filter("n IS NOT NULL AND va IS NOT NULL AND vb IS NOT NULL")
    one = found.filter(F.col("__nth") == nth) if nth is not None else found.groupBy("__key").agg(F.min(F.struct("__nth", "__head", "n", "va", "vb")).alias("t")).select("__key", "t.*")
    met = rows.join(one, F.col(key).eqNullSafe(F.col("__key")) & (F.col("nth") == F.col("__nth"))).filter("pos > __head")
    cell = F.try_element_at("cells", F.col("n")) if name else F.get(F.filter("cells", lambda c: c["text"].rlike(r"\p{L}")), 0)
    number = lambda at: T.number(F.try_element_at("cells", F.col(at))["text"])
    told = met.select(key, cell.alias("c"), number("va").alias("a"), number("vb").alias("b")).select(key, F.coalesce(F.nullif("c.link", F.lit("")), F.nullif("c.text", F.lit(""))).alias("name"), "a", "b")
    return told.select(key, "name", F.expr(derive).alias("value")).filter("name IS NOT NULL AND value IS NOT NULL")


def csv_series(rows: DataFrame, key: str, text: str, years: tuple[int, int]) -> DataFrame:
    """key, entity and columns y1993, y1994 ... for the years between ``years``, from texts of lines entity,year,value with a header."""
    lines = rows.select(key, F.explode(F.slice(F.split(text, "\n"), 2, 1 << 30)).alias("line"))
    parsed = lines.select(key, F.from_csv("line", "entity string, year int, value double").alias("r")).select(key, "r.entity", "r.year", "r.value")
    kept = parsed.filter(F.col("year").between(*years) & F.col("entity").isNotNull())
    named = kept.withColumn("year", F.concat(F.lit("y"), "year"))
    return named.groupBy(key, "entity").pivot("year", [f"y{y}" for y in range(years[0], years[1] + 1)]).agg(F.first("value", ignorenulls=True))
