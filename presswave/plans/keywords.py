"""Keyword plans: trending and rising keywords, analytics, daily rollups.

In the test tables a brand stands for a keyword, an order line for its use in an article, the order's date
for the article's, the supplier's nation for the source country and the customer's for the country it is about.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presswave.functions import scoring
from presswave.functions.registry import query, read
from presswave.operators.relational import distinct_on, ordered_list, top_k

AS_OF = "2001-08-02"
STOPWORDS = ("Brand#11", "Brand#22")
TRANSLATIONS = (("Brand#12", "twelve"), ("Brand#13", "twelve"), ("Brand#23", "brand#23"))


def uses(spark: SparkSession, sf_dir: str, since: int | None = None, until: bool = False) -> DataFrame:
    """Keyword uses of the last ``since`` days; the range is on the stored date and stopwords go first, so both reach the scans."""
    at = lambda days: F.expr(f"TIMESTAMP_NTZ'{AS_OF} 00:00:00' - INTERVAL {days} DAYS")
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity")
    orders = read(spark, sf_dir, "orders")
    if since is not None:
        orders = orders.filter(F.col("o_orderdate") >= at(since))
    if until:
        orders = orders.filter(F.col("o_orderdate") < at(-1))
    orders = orders.select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("day"), "o_totalprice")
    part = read(spark, sf_dir, "part").filter(~F.col("p_brand").isin(*STOPWORDS)).select("p_partkey", F.col("p_brand").alias("keyword"))
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).join(part, F.col("l_partkey") == part.p_partkey)


def translated(df: DataFrame) -> DataFrame:
    """Canonical keywords: stopwords went before translation and go after it."""
    stop = df.sparkSession.createDataFrame([(w,) for w in STOPWORDS], "word string")
    names = df.sparkSession.createDataFrame(TRANSLATIONS, "original string, normalised string")
    known = df.join(F.broadcast(names), F.col("keyword") == names.original, "left")
    canonical = known.withColumn("keyword", F.lower(F.coalesce("normalised", "keyword"))).drop("original", "normalised")
    return canonical.join(F.broadcast(stop), canonical.keyword == F.lower(stop.word), "left_anti")


USES = """uses AS (SELECT l_orderkey, l_suppkey, l_quantity, o_custkey, o_totalprice, CAST(o_orderdate AS DATE) AS day, p_brand AS keyword
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
  names AS (SELECT * FROM (VALUES ('Brand#12', 'twelve'), ('Brand#13', 'twelve'), ('Brand#23', 'brand#23')) t(original, normalised)),
  canon AS (SELECT u.* EXCLUDE (keyword), lower(coalesce(normalised, keyword)) AS keyword FROM uses u LEFT JOIN names ON keyword = original
    WHERE keyword NOT IN ('Brand#11', 'Brand#22') AND lower(coalesce(normalised, keyword)) NOT IN ('brand#11', 'brand#22'))"""


@query(f"""WITH {USES} SELECT keyword, count(*) AS total, count(DISTINCT l_orderkey) AS articles FROM canon
    WHERE day >= DATE '{AS_OF}' - 365 AND day <= DATE '{AS_OF}' GROUP BY keyword HAVING count(*) >= 5 ORDER BY total DESC, keyword LIMIT 15""")
def trending_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts over a window of days, stopwords out, translations merged, the most used first."""
    recent = translated(uses(spark, sf_dir, 365, until=True))
    counted = recent.groupBy("keyword").agg(F.count("*").alias("total"), F.countDistinct("l_orderkey").alias("articles"))
    return counted.filter("total >= 5").orderBy(F.desc("total"), "keyword").limit(15)


@query(f"""WITH {USES}, c AS (SELECT keyword, count(*) FILTER (WHERE day >= DATE '{AS_OF}' - 90) AS recent,
      count(*) FILTER (WHERE day < DATE '{AS_OF}' - 90) AS baseline FROM canon WHERE day >= DATE '{AS_OF}' - 510 GROUP BY keyword)
    SELECT keyword, recent, baseline, CASE WHEN baseline = 0 THEN recent * 10.0 ELSE round(recent / baseline * (420.0 / 90), 2) END AS momentum FROM c WHERE recent >= 3""")
def rising_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditional counts of a recent and a baseline window, and their ratio by day."""
    day = F.lit(AS_OF).cast("date")
    used = translated(uses(spark, sf_dir, 510))
    new = F.col("day") >= F.date_sub(day, 90)
    counted = used.groupBy("keyword").agg(F.count_if(new).alias("recent"), F.count_if(~new).alias("baseline")).filter("recent >= 3")
    return counted.withColumn("momentum", scoring.momentum(F.col("recent"), F.col("baseline"), 90, 420))


@query(f"""WITH {USES}, p AS (SELECT * FROM canon WHERE day >= DATE '{AS_OF}' - 365),
    c AS (SELECT keyword, s_nationkey AS nation, count(*) AS n FROM p JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY keyword ORDER BY n DESC, nation) AS rn, sum(n) OVER (PARTITION BY keyword) AS total FROM c)
    SELECT keyword, nation, n, rn, round(100.0 * n / total, 2) AS pct FROM r WHERE rn <= 3""")
def keyword_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each keyword's three main source countries with their share."""
    from pyspark.sql import Window

    used = translated(uses(spark, sf_dir, 365))
    supplier = read(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"))
    counted = used.join(supplier, used.l_suppkey == supplier.s_suppkey).groupBy("keyword", "nation").agg(F.count("*").alias("n"))
    shared = counted.withColumn("total", F.sum("n").over(Window.partitionBy("keyword")))
    best = top_k(shared, ["keyword"], [F.desc("n"), F.col("nation")], 3, "rn")
    return best.select("keyword", "nation", "n", "rn", F.round(100.0 * F.col("n") / F.col("total"), 2).alias("pct"))


@query(f"""WITH {USES}, a AS (SELECT DISTINCT keyword, l_orderkey, day, o_totalprice FROM canon WHERE day >= DATE '{AS_OF}' - 365),
    r AS (SELECT *, row_number() OVER (PARTITION BY keyword ORDER BY day DESC, o_totalprice DESC, l_orderkey) AS rn FROM a)
    SELECT keyword, count(*) AS articles, max(day) AS newest, list(l_orderkey ORDER BY rn) FILTER (WHERE rn <= 5) AS newest_five, arg_max(l_orderkey, (o_totalprice, -l_orderkey)) AS dearest FROM r GROUP BY keyword""")
def keyword_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered lists and arg-max per keyword: the newest five articles and the dearest."""
    used = translated(uses(spark, sf_dir, 365)).select("keyword", "l_orderkey", "day", "o_totalprice").distinct()
    newest = top_k(used, ["keyword"], [F.desc("day"), F.desc("o_totalprice"), F.col("l_orderkey")], 5, "rn")
    lists = newest.groupBy("keyword").agg(ordered_list("l_orderkey", F.col("rn")).alias("newest_five"))
    totals = used.groupBy("keyword").agg(F.count("*").alias("articles"), F.max("day").alias("newest"), F.max_by("l_orderkey", F.struct("o_totalprice", -F.col("l_orderkey"))).alias("dearest"))
    return totals.join(lists, "keyword").select("keyword", "articles", "newest", "newest_five", "dearest")


@query(f"""WITH {USES} SELECT keyword, day, s_nationkey AS nation, count(*) AS uses, count(l_quantity) AS sent_n, coalesce(sum(l_quantity), 0) AS sent_sum
    FROM canon JOIN supplier ON l_suppkey = s_suppkey WHERE day >= DATE '{AS_OF}' - 60 GROUP BY ALL""")
def keyword_country_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily rollup with a mergeable mean (count and sum)."""
    used = translated(uses(spark, sf_dir, 60))
    supplier = read(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"))
    return used.join(supplier, used.l_suppkey == supplier.s_suppkey).groupBy("keyword", "day", "nation").agg(F.count("*").alias("uses"), F.count("l_quantity").alias("sent_n"), F.coalesce(F.sum("l_quantity"), F.lit(0.0)).alias("sent_sum"))


@query(f"""WITH {USES} SELECT keyword, s_nationkey AS src, c_nationkey AS dst, count(*) AS flow FROM canon JOIN supplier ON l_suppkey = s_suppkey JOIN customer ON o_custkey = c_custkey
    WHERE day >= DATE '{AS_OF}' - 180 AND s_nationkey IS DISTINCT FROM c_nationkey GROUP BY ALL HAVING count(*) >= 2""")
def keyword_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flow edges from source country to country concerned."""
    used = translated(uses(spark, sf_dir, 180))
    supplier = read(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("src"))
    customer = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("dst"))
    placed = used.join(supplier, used.l_suppkey == supplier.s_suppkey).join(customer, used.o_custkey == customer.c_custkey)
    return placed.filter(~F.col("src").eqNullSafe(F.col("dst"))).groupBy("keyword", "src", "dst").agg(F.count("*").alias("flow")).filter("flow >= 2")


@query("""WITH w AS (SELECT doc_id, unnest(string_split_regex(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+')) AS w FROM documents),
    k AS (SELECT doc_id, w, count(*) AS tf FROM w WHERE length(w) >= 4 GROUP BY ALL), f AS (SELECT w, count(*) AS df FROM k GROUP BY w),
    s AS (SELECT doc_id, w, round(tf * ln(1 + (SELECT count(*) FROM documents) / df), 6) AS weight FROM k JOIN f USING (w)),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, w) AS rn FROM s) SELECT doc_id, w AS word, weight, rn FROM r WHERE rn <= 16""")
def tfidf_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sixteen heaviest words of every document by tf times ln(1 + N / df)."""
    from presswave.functions.text import word_list

    docs = read(spark, sf_dir, "documents")
    counts = docs.select("doc_id", F.explode(word_list(F.col("text"), 4)).alias("word")).groupBy("doc_id", "word").agg(F.count("*").alias("tf"))
    df = counts.groupBy("word").agg(F.count("*").alias("df"))
    total = docs.agg(F.count("*").alias("total"))
    weighted = counts.join(df, "word").crossJoin(F.broadcast(total)).select("doc_id", "word", F.round(F.col("tf") * F.log(1 + F.col("total") / F.col("df")), 6).alias("weight"))
    return top_k(weighted, ["doc_id"], [F.desc("weight"), F.col("word")], 16, "rn")


@query(f"""WITH {USES}, d AS (SELECT keyword, l_orderkey, day, row_number() OVER (PARTITION BY keyword ORDER BY day, l_orderkey) AS rn FROM canon)
    SELECT keyword, l_orderkey AS first_article, day AS first_day FROM d WHERE rn = 1""")
def first_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per keyword, its earliest article."""
    first = distinct_on(translated(uses(spark, sf_dir)), ["keyword"], [F.col("day"), F.col("l_orderkey")])
    return first.select("keyword", F.col("l_orderkey").alias("first_article"), F.col("day").alias("first_day"))
