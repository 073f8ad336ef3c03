"""The parsers over texts made from the test tables, against the values the texts were made of."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presswave.functions.registry import query, read
from presswave.sources import parsers, selection


@query("SELECT s_nationkey, s_name || ' & <co>' AS title, CASE s_nationkey % 3 WHEN 2 THEN NULL ELSE 1 END AS titled, 'http://x/' || s_suppkey AS link, '2024-01-' || (10 + s_suppkey % 20) AS published FROM supplier WHERE s_nationkey % 3 < 2 UNION ALL SELECT s_nationkey, NULL, NULL, 'http://x/' || s_suppkey, '2024-01-' || (10 + s_suppkey % 20) FROM supplier WHERE s_nationkey % 3 = 2")
def feed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RSS, Atom and sitemap texts, one for each nation."""
    s = read(spark, sf_dir, "supplier").select("s_nationkey", F.concat("s_name", F.lit(" &amp; &lt;co&gt;")).alias("t"), F.concat(F.lit("http://x/"), "s_suppkey").alias("l"), F.concat(F.lit("2024-01-"), (10 + F.col("s_suppkey") % 20).cast("string")).alias("d"))
    of = lambda *parts: F.array_join(F.collect_list(F.concat(*(F.col(p) if len(p) == 1 else F.lit(p) for p in parts))), "")
    rss = F.concat(F.lit("<rss><channel>"), of("<item><title>", "t", "</title><link>", "l", "</link><pubDate>", "d", "</pubDate></item>"), F.lit("</channel></rss>"))
    atom = F.concat(F.lit("<feed>"), of("<entry><title>", "t", '</title><link href="', "l", '"/><updated>', "d", "</updated></entry>"), F.lit("</feed>"))
    sitemap = F.concat(F.lit("<urlset>"), of("<url><loc>", "l", "</loc><lastmod>", "d", "</lastmod></url>"), F.lit("</urlset>"))
    feeds = s.groupBy("s_nationkey").agg(rss.alias("r"), atom.alias("a"), sitemap.alias("m")).select("s_nationkey", F.when(F.col("s_nationkey") % 3 == 0, F.col("r")).when(F.col("s_nationkey") % 3 == 1, F.col("a")).otherwise(F.col("m")).alias("xml"))
    return parsers.feed_items(feeds, "s_nationkey", "xml").select("s_nationkey", "title", F.when(F.col("title").isNotNull(), 1).alias("titled"), "link", "published")


@query("""WITH l AS (SELECT page_id, regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a>', 1) AS h, regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a>', 2) AS t FROM pages WHERE html IS NOT NULL)
    SELECT page_id, unnest(h) AS link, trim(unnest(t)) AS title, unnest(range(len(h)))::INT AS pos FROM l""")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of the list items of every page."""
    return parsers.html_links(read(spark, sf_dir, "pages"), "page_id", "html")


@query("SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1)::INT AS pos, event_type AS title, CAST(event_id AS VARCHAR) AS id FROM events")
def json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of JSON answers by dot paths."""
    item = F.struct(F.struct(F.col("event_type").alias("main")).alias("headline"), F.col("event_id").alias("id"))
    answers = read(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", item.alias("x")))).alias("x"))
    told = answers.select("user_id", F.to_json(F.struct(F.struct(F.transform("x", lambda x: x["x"]).alias("items")).alias("data"))).alias("text"))
    return parsers.json_items(told, "user_id", "text", "data.items", {"title": "headline.main", "id": "id"})


@query("""WITH s AS (SELECT p_brand, p_size, count(*) AS n, round(sum(p_retailprice), 1) AS total FROM part GROUP BY ALL) SELECT p_brand, 'size ' || p_size AS name, round(total / n, 4) AS value FROM s""")
def html_table_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quotient of two columns of the second table of pages, found by their headers; names are links, cells have footnotes, separators and a table of their own."""
    s = read(spark, sf_dir, "part").groupBy("p_brand", "p_size").agg(F.count("*").alias("n"), F.round(F.sum("p_retailprice"), 1).alias("total"))
    row = F.concat(F.lit("<tr><td><b><a href=/s>size "), "p_size", F.lit("</a></b> (class)<td>"), F.format_number("total", 1), F.lit(" 12 [2] (est.)</td><td>"), "n", F.lit("&nbsp;<table><tr><td>77</td></tr></table></td></tr>"))
    box = "<table class=infobox><tr><td>Brand</td><td>3,000</td></tr></table>"
    head = "<table class=wikitable><caption>Parts</caption><tr><th>Size class</th><th>Total price ($)</th><th>Number</th></tr>"
    pages = s.groupBy("p_brand").agg(F.concat(F.lit(box + head), F.array_join(F.collect_list(row), "\n"), F.lit("</table>")).alias("html"))
    out = parsers.table_values(pages, "p_brand", "html", ("size",), ("total", "price"), "number of parts", "try_divide(a, b)")
    return out.select("p_brand", "name", F.round("value", 4).alias("value"))


@query("""SELECT s_nationkey, (row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1)::INT AS pos, '/s/' || s_suppkey AS link, lower(s_name) AS title FROM supplier""")
def selected_page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headline links of cards, told from menus and adverts by a selector."""
    s = read(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey", F.lower("s_name").alias("t"))
    card = F.concat(F.lit('<div class="card big" data-kind=story><h2><a href="/s/'), "s_suppkey", F.lit('">'), "t", F.lit("</a></h2><a href=/more>more</a></div><div class=card><a href=/ad>advert</a></div>"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", card.alias("c")))), lambda x: x["c"]), "")
    pages = s.groupBy("s_nationkey").agg(F.concat(F.lit("<nav><ul><li><a href=/>home</a></ul></nav><main id=list>"), listed, F.lit("</main>")).alias("html"))
    return selection.selected_links(pages, "s_nationkey", "html", "#list > div.card[data-kind=story] h2")


@query("""WITH y AS (SELECT n_regionkey, 'N' || c_nationkey AS entity, year(o_orderdate) AS y, sum(o_totalprice)::BIGINT::DOUBLE AS v FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL)
    SELECT n_regionkey, entity, max(v) FILTER (WHERE y = 1996) AS y1996, max(v) FILTER (WHERE y = 1997) AS y1997, max(v) FILTER (WHERE y = 1998) AS y1998 FROM y WHERE y BETWEEN 1996 AND 1998 GROUP BY ALL""")
def csv_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series by year from CSV texts."""
    o, c, n = (read(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    y = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).groupBy("n_regionkey", F.concat(F.lit("N"), "c_nationkey").alias("entity"), F.year("o_orderdate").alias("y")).agg(F.round(F.sum("o_totalprice"), 0).cast("long").alias("v"))
    texts = y.groupBy("n_regionkey").agg(F.concat(F.lit("Entity,Year,Value\n"), F.array_join(F.collect_list(F.concat_ws(",", "entity", "y", "v")), "\n")).alias("csv"))
    return parsers.csv_series(texts, "n_regionkey", "csv", (1996, 1998))
