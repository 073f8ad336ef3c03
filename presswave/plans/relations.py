"""Filters, joins, aggregates, windows and set operations, one query each over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from presswave.functions.registry import query, read
from presswave.operators import relational as R


@query("SELECT event_id, user_id, value FROM events WHERE ts > TIMESTAMP '2024-01-31' - INTERVAL 7 DAYS AND user_id IN (1, 2, 3, 5, 8) AND event_type IS DISTINCT FROM 'click'")
def sliding_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last days before an as-of time, a key list, a null-safe inequality."""
    e = read(spark, sf_dir, "events")
    since = F.expr("TIMESTAMP_NTZ '2024-01-31 00:00:00' - INTERVAL 7 DAYS")
    return e.filter((F.col("ts") > since) & F.col("user_id").isin(1, 2, 3, 5, 8) & ~F.col("event_type").eqNullSafe("click")).select("event_id", "user_id", "value")


@query("SELECT CAST(ts AS DATE) AS day, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE ts >= DATE '2024-01-10' AND ts < DATE '2024-01-13' GROUP BY 1")
def day_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").filter("ts >= DATE'2024-01-10' AND ts < DATE'2024-01-13'")
    return e.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE json_exists(props, '$.k') AND CAST(json_extract_string(props, '$.k') AS BIGINT) BETWEEN 10 AND 20")
def json_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return read(spark, sf_dir, "events").filter(F.array_contains(F.json_object_keys("props"), "k") & k.between(10, 20)).select("event_id", k.alias("k"))


@query("SELECT doc_id FROM documents WHERE regexp_matches(lower(text), '\\bthe\\b') AND NOT regexp_matches(text, '!!') AND text ILIKE '%tion%'")
def text_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word-bounded pattern, negated pattern, case-insensitive containment."""
    t = F.lower("text")
    return read(spark, sf_dir, "documents").filter(t.rlike(r"\bthe\b") & ~F.col("text").rlike("!!") & t.contains("tion")).select("doc_id")


@query("""WITH w AS (SELECT doc_id, list_distinct(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+')) AS ws FROM documents)
    SELECT doc_id FROM w WHERE len(list_filter(ws, lambda x: starts_with(x, 'ther'))) > 0 AND len(list_filter(ws, lambda x: starts_with(x, 'and'))) > 0""")
def prefix_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from presswave.functions.text import has_prefixes

    return read(spark, sf_dir, "documents").filter(has_prefixes(F.col("text"), ("ther", "and"))).select("doc_id")


@query("""WITH a AS (SELECT l_orderkey, list(DISTINCT l_returnflag) AS flags FROM lineitem GROUP BY 1)
    SELECT l_orderkey, list_has_any(flags, ['A', 'N']) AS overlaps, list_has_all(flags, ['A', 'R']) AS holds, len(flags) AS n FROM a""")
def array_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap, containment and cardinality of arrays."""
    a = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("flags"))
    lit = lambda *x: F.array(*map(F.lit, x))
    return a.select("l_orderkey", F.arrays_overlap("flags", lit("A", "N")).alias("overlaps"), (F.size(F.array_except(lit("A", "R"), F.col("flags"))) == 0).alias("holds"), F.size("flags").alias("n"))


@query("""SELECT CASE WHEN p_size < 10 THEN 'small' WHEN p_size BETWEEN 10 AND 30 THEN 'medium' ELSE 'large' END AS bucket, count(*) AS n, round(avg(p_retailprice), 4) AS price FROM part GROUP BY 1""")
def case_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    bucket = F.when(F.col("p_size") < 10, "small").when(F.col("p_size").between(10, 30), "medium").otherwise("large")
    return read(spark, sf_dir, "part").groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.round(F.avg("p_retailprice"), 4).alias("price"))


@query("""SELECT user_id, CASE WHEN user_id % 2 = 0 THEN 'youtube:' || user_id ELSE 'news:' || user_id END AS source_key, count(*) AS n FROM events GROUP BY ALL""")
def source_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of two id spaces in one column."""
    kind = F.when(F.col("user_id") % 2 == 0, F.lit("youtube:")).otherwise(F.lit("news:"))
    return read(spark, sf_dir, "events").groupBy("user_id", F.concat(kind, F.col("user_id").cast("string")).alias("source_key")).agg(F.count("*").alias("n"))


@query("""WITH l AS (SELECT o_custkey, max(o_orderdate) AS last FROM orders GROUP BY 1)
    SELECT c_custkey FROM customer LEFT JOIN l ON c_custkey = o_custkey
    WHERE last IS NULL OR last < TIMESTAMP '2001-08-02' - CASE c_nationkey % 3 WHEN 0 THEN INTERVAL 30 DAYS WHEN 1 THEN INTERVAL 180 DAYS ELSE INTERVAL 365 DAYS END""")
def due_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is due: never run, or last run longer ago than its tier allows."""
    last = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("last"))
    days = F.when(F.col("c_nationkey") % 3 == 0, 30).when(F.col("c_nationkey") % 3 == 1, 180).otherwise(365)
    due = F.expr("TIMESTAMP'2001-08-02 00:00:00'") - F.make_interval(days=days)
    return read(spark, sf_dir, "customer").join(last, F.col("c_custkey") == last.o_custkey, "left").filter(F.col("last").isNull() | (F.col("last").cast("timestamp") < due)).select("c_custkey")


@query("""SELECT c_mktsegment, n_name, r_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""")
def star_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equi-joins to dimensions; small ones are broadcast where Spark's size check allows it."""
    o, c, n, r = (read(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region"))
    full = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return full.groupBy("c_mktsegment", "n_name", "r_name").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""SELECT c_custkey, count(o_orderkey) AS urgent FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderpriority = '1-URGENT' GROUP BY 1""")
def left_join_on(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Left join with another predicate in its condition."""
    c, o = read(spark, sf_dir, "customer"), read(spark, sf_dir, "orders")
    return c.join(o, (c.c_custkey == o.o_custkey) & (o.o_orderpriority == "1-URGENT"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("urgent"))


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000)")
def anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = read(spark, sf_dir, "orders").filter("o_totalprice > 100000").select("o_custkey")
    return read(spark, sf_dir, "customer").join(big, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT s_suppkey, s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity >= 50) AS bulk FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3)")
def semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Semi-join, and existence as a column."""
    bulk = read(spark, sf_dir, "lineitem").filter("l_quantity >= 50").select("l_suppkey").distinct()
    nations = read(spark, sf_dir, "nation").filter("n_regionkey < 3").select("n_nationkey")
    s = read(spark, sf_dir, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey"), "left_semi")
    return s.join(bulk, s.s_suppkey == bulk.l_suppkey, "left").select("s_suppkey", F.col("l_suppkey").isNotNull().alias("bulk"))


@query("""SELECT c_custkey, t.o_orderkey AS top_order, t.o_totalprice AS top_price, coalesce(a.n, 0) AS n, coalesce(a.late, false) AS late FROM customer
    LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn = 1) t ON t.o_custkey = c_custkey
    LEFT JOIN (SELECT o_custkey, count(*) AS n, bool_or(o_orderstatus = 'F') AS late FROM orders GROUP BY 1) a ON a.o_custkey = c_custkey""")
def lateral_top_and_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best child of every parent and an aggregate over its children, nulls filled."""
    o = read(spark, sf_dir, "orders")
    top = R.distinct_on(o, ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")]).select("o_custkey", F.col("o_orderkey").alias("top_order"), F.col("o_totalprice").alias("top_price"))
    some = o.groupBy("o_custkey").agg(F.count("*").alias("n"), F.bool_or(F.col("o_orderstatus") == "F").alias("late"))
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"))
    out = c.join(top, "o_custkey", "left").join(some, "o_custkey", "left")
    return out.select(F.col("o_custkey").alias("c_custkey"), "top_order", "top_price", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("late", F.lit(False)).alias("late"))


@query("""WITH p AS (SELECT a.event_id AS a, b.event_id AS b, abs(epoch(a.ts) - epoch(b.ts)) AS gap FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_id < b.event_id AND abs(epoch(a.ts) - epoch(b.ts)) <= 3600),
    r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY gap, b) AS rn FROM p) SELECT a, b, round(gap, 3) AS gap FROM r WHERE rn <= 5""")
def band_self_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user within an hour, the five nearest of each."""
    e = read(spark, sf_dir, "events").select("user_id", "event_id", F.expr("CAST(ts AS TIMESTAMP)").cast("double").alias("t"))
    a, b = e.select("user_id", F.col("event_id").alias("a"), F.col("t").alias("ta")), e.select("user_id", F.col("event_id").alias("b"), F.col("t").alias("tb"))
    pairs = R.band_join(a, b, "ta", "tb", 3600, ["user_id"]).filter("a < b").withColumn("gap", F.abs(F.col("ta") - F.col("tb")))
    return R.top_k(pairs, ["a"], [F.col("gap"), F.col("b")], 5).select("a", "b", F.round("gap", 3).alias("gap"))


@query("""WITH k AS (SELECT DISTINCT l_orderkey AS n, l_partkey AS k FROM lineitem), u AS (SELECT k FROM k GROUP BY k HAVING count(*) BETWEEN 2 AND 200)
    SELECT x.n AS a, y.n AS b, count(*) AS shared FROM k x JOIN k y ON x.k = y.k AND x.n < y.n WHERE x.k IN (SELECT k FROM u) GROUP BY ALL HAVING count(*) >= 2""")
def blocked_self_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of orders that share two parts or more, through an inverted index without stop keys."""
    return R.blocked_pairs(read(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey", 2, 200, 2)


@query("""WITH p AS (SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey) SELECT * FROM p""")
def upper_triangle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs inside a cluster, each once."""
    n = read(spark, sf_dir, "nation")
    return n.selectExpr("n_regionkey", "n_nationkey AS a").join(n.selectExpr("n_regionkey", "n_nationkey AS b"), "n_regionkey").filter("a < b").select("a", "b")


@query("""WITH w AS (SELECT o_custkey, o_orderkey, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS up, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS down, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
    SELECT o_custkey, o_orderkey, up FROM w WHERE up = 1 OR down = 1 OR up IN ((n + 3) // 4, (n + 1) // 2, (3 * n + 1) // 4)""")
def quartile_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First, quartiles and last of each group by two ranks and a count."""
    by = Window.partitionBy("o_custkey")
    w = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.row_number().over(by.orderBy("o_orderdate", "o_orderkey")).alias("up"), F.row_number().over(by.orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))).alias("down"), F.count("*").over(by).alias("n"))
    return w.filter("up = 1 OR down = 1 OR up IN ((n + 3) div 4, (n + 1) div 2, (3 * n + 1) div 4)").select("o_custkey", "o_orderkey", "up")


@query("""SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_totalprice DESC NULLS LAST, o_orderkey) AS rn FROM orders) WHERE rn <= 3""")
def recent_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.top_k(read(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.col("o_totalprice").desc_nulls_last(), F.col("o_orderkey")], 3).select("o_custkey", "o_orderkey", "o_totalprice")


@query("""SELECT count(*) AS n, count(DISTINCT user_id) AS users, count(*) FILTER (WHERE value > 50) AS big, count(DISTINCT user_id) FILTER (WHERE value > 50) AS big_users, round(stddev_pop(value), 6) AS sd, event_type,
    round(coalesce(sum(value), 0), 4) AS total, max(CASE WHEN user_id % 2 = 0 THEN value ELSE 0 END) AS even_max, round(count(*) / greatest(1, (epoch(max(ts)) - epoch(min(ts))) / 86400), 6) AS per_day FROM events GROUP BY event_type HAVING count(*) > 1 OR max(value) > 10""")
def aggregate_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct, filtered, conditional and rate aggregates with a two-part HAVING."""
    big, span = F.col("value") > 50, (F.max(F.col("ts").cast("timestamp").cast("double")) - F.min(F.col("ts").cast("timestamp").cast("double"))) / 86400
    out = read(spark, sf_dir, "events").groupBy("event_type").agg(
        F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.count_if(big).alias("big"), F.countDistinct(F.when(big, F.col("user_id"))).alias("big_users"),
        F.round(F.stddev_pop("value"), 6).alias("sd"), F.round(F.coalesce(F.sum("value"), F.lit(0.0)), 4).alias("total"), F.max(F.when(F.col("user_id") % 2 == 0, F.col("value")).otherwise(0.0)).alias("even_max"),
        F.round(F.count("*") / F.greatest(F.lit(1.0), span), 6).alias("per_day"), F.max("value").alias("top"),
    )
    return out.filter("n > 1 OR top > 10").drop("top")


@query("""SELECT bucket, count(*) AS keys, sum(n) AS uses FROM (SELECT CASE WHEN n = 1 THEN '1' WHEN n <= 20 THEN '2-20' WHEN n <= 40 THEN '21-40' ELSE '41+' END AS bucket, n FROM (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1)) GROUP BY bucket""")
def counts_of_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A histogram over group sizes: two levels of aggregation."""
    n = read(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"))
    bucket = F.when(F.col("n") == 1, "1").when(F.col("n") <= 20, "2-20").when(F.col("n") <= 40, "21-40").otherwise("41+")
    return n.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("keys"), F.sum("n").alias("uses"))


@query("""WITH a AS (SELECT l_suppkey, list(DISTINCT l_shipdate::DATE ORDER BY l_shipdate::DATE) AS days FROM lineitem GROUP BY 1)
    SELECT n_nationkey, len(list_distinct(flatten(list(days)))) AS days FROM a JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1""")
def array_union_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union of arrays across rows: their elements are rows, so no group gathers the arrays."""
    a = read(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.collect_set(F.to_date("l_shipdate")).alias("days"))
    s = read(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("n_nationkey"))
    return a.join(s, a.l_suppkey == s.s_suppkey).select("n_nationkey", F.explode("days").alias("day")).groupBy("n_nationkey").agg(F.countDistinct("day").alias("days"))


@query("""SELECT r_regionkey, coalesce('[' || string_agg('{"n":' || n || ',"name":"' || n_name || '"}', ',' ORDER BY n DESC, n_name) FILTER (WHERE n >= 70) || ']', '[]') AS nations FROM (SELECT r_regionkey, n_name, count(*) AS n FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL) GROUP BY 1""")
def json_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON array of the larger groups in an order, [] where there is none."""
    n = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "customer"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_regionkey").alias("r_regionkey"), "n_name").agg(F.count("*").alias("n"))
    large = F.when(F.col("n") >= 70, F.struct((-F.col("n")).alias("down"), F.col("n_name").alias("name"), "n"))
    listed = F.transform(F.array_sort(F.collect_list(large)), lambda s: F.struct(s["n"].alias("n"), s["name"].alias("name")))
    return n.groupBy("r_regionkey").agg(F.to_json(listed).alias("nations"))


@query("""SELECT DISTINCT k FROM (SELECT o_custkey AS k FROM orders WHERE o_totalprice > 300000 UNION SELECT c_custkey FROM customer WHERE c_acctbal > 9000 UNION SELECT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '2001-06-01')""")
def union_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct union of differently filtered branches."""
    o, c = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    one, two = o.filter("o_totalprice > 300000").selectExpr("o_custkey AS k"), c.filter("c_acctbal > 9000").selectExpr("c_custkey AS k")
    return one.union(two).union(o.filter("o_orderdate >= TIMESTAMP'2001-06-01 00:00:00'").selectExpr("o_custkey AS k")).distinct()


@query("""WITH p AS (SELECT o_custkey, o_orderkey, 0 AS pool FROM orders WHERE o_orderpriority = '1-URGENT' UNION ALL SELECT o_custkey, o_orderkey, 1 FROM orders WHERE o_totalprice > 200000 UNION ALL SELECT o_custkey, o_orderkey, 2 FROM orders)
    SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY pool, o_orderkey) AS rn FROM p) WHERE rn = 1""")
def fallback_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first pool that has a row for the key wins."""
    o = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", "o_totalprice")
    pools = [o.filter("o_orderpriority = '1-URGENT'"), o.filter("o_totalprice > 200000"), o]
    return R.first_of([p.select("o_custkey", "o_orderkey") for p in pools], ["o_custkey"], [F.col("o_orderkey")])


@query("""SELECT o_orderkey, o_custkey, rn FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 2 ORDER BY rn, o_totalprice DESC, o_orderkey LIMIT 50""")
def capped_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most two per source in encounter order, then the first fifty."""
    capped = R.top_k(read(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 2, "rn")
    return capped.orderBy("rn", F.desc("o_totalprice"), "o_orderkey").limit(50).select("o_orderkey", "o_custkey", "rn")


@query("SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 20 OFFSET 10")
def offset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").orderBy(F.col("p_retailprice").desc_nulls_last(), "p_partkey").offset(10).limit(20).select("p_partkey", "p_retailprice")


@query("""WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
    SELECT o_custkey, o_orderkey FROM r WHERE n <= 5 OR i = 0 OR i = n - 1 OR (i * 5) // n > ((i - 1) * 5) // n""")
def stride_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evenly spread sample with the first and the newest row forced in (a sampling operator)."""
    by = Window.partitionBy("o_custkey")
    r = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (F.row_number().over(by.orderBy("o_orderdate", "o_orderkey")) - 1).alias("i"), F.count("*").over(by).alias("n"))
    return r.filter("n <= 5 OR i = 0 OR i = n - 1 OR (i * 5) div n > ((i - 1) * 5) div n").select("o_custkey", "o_orderkey")


@query("""SELECT c_custkey, o_orderkey, c_name FROM (SELECT c.c_custkey, o.o_orderkey, c.c_name, row_number() OVER (PARTITION BY c.c_nationkey ORDER BY length(c.c_name), c.c_custkey, o.o_orderkey) AS rn FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey) WHERE rn <= 3""")
def shortest_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of several matches the shortest name wins."""
    c, o = read(spark, sf_dir, "customer"), read(spark, sf_dir, "orders")
    return R.top_k(c.join(o, c.c_custkey == o.o_custkey), ["c_nationkey"], [F.length("c_name"), F.col("c_custkey"), F.col("o_orderkey")], 3).select("c_custkey", "o_orderkey", "c_name")
