"""Scores, tiers, text measures and rerankers over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from presswave.functions import scoring as S
from presswave.functions import text as T
from presswave.functions.registry import query, read
from presswave.operators import relational as R
from presswave.operators import rerank
from presswave.storage import materialize


@query("""WITH a AS (SELECT event_id, value, user_id, (epoch(TIMESTAMP '2024-01-31') - epoch(date_trunc('second', ts))) / 3600.0 AS age FROM events)
    SELECT event_id, round(greatest(0.05, pow(0.5, age / 24)), 6) AS decay, round(least(greatest(value / 10, 0.1), 1.0) * exp(-age / 36), 4) AS relevance,
    round(value * (0.85 * greatest(0.05, pow(0.5, age / 24)) + 0.15 * 0.5) * CASE WHEN user_id % 4 = 0 THEN 6.0 ELSE 1.0 END * CASE WHEN user_id % 5 = 0 THEN 1.18 ELSE 1.0 END * CASE WHEN user_id % 6 = 0 THEN 0.01 ELSE 1.0 END * CASE event_id % 5 WHEN 0 THEN 3.0 WHEN 1 THEN 1.55 WHEN 2 THEN 1.05 ELSE 1.0 END, 7) AS priority FROM a""")
def article_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    age = S.hours_between(F.expr("TIMESTAMP'2024-01-31 00:00:00'"), F.col("ts").cast("timestamp"))
    e = read(spark, sf_dir, "events").withColumn("age", age)
    tier = F.when(F.col("user_id") % 4 == 0, 4).otherwise(1)
    state = F.when(F.col("event_id") % 5 == 0, "active").when(F.col("event_id") % 5 == 1, "cooling").when(F.col("event_id") % 5 == 2, "dormant")
    return e.select("event_id", F.round(S.decay(F.col("age")), 6).alias("decay"), S.relevance(F.col("value"), F.col("age")).alias("relevance"), F.round(S.priority(F.col("value"), F.col("age"), F.lit(0.5), tier, F.col("user_id") % 5 == 0, F.col("user_id") % 6 == 0, state), 7).alias("priority"))


@query("""WITH a AS (SELECT event_type, count(DISTINCT user_id) FILTER (WHERE ts > TIMESTAMP '2024-01-30') AS d, avg(value) AS m, max(value) AS x, (epoch(TIMESTAMP '2024-01-31') - epoch(date_trunc('second', max(ts)))) / 3600.0 AS age FROM events GROUP BY 1)
    SELECT event_type, round(d * greatest(0.2, exp(-age / 36)) * (0.4 + m + 0.25 * x), 4) AS signal FROM a""")
def breaking_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = read(spark, sf_dir, "events").groupBy("event_type").agg(F.countDistinct(F.when(F.col("ts") > F.expr("TIMESTAMP_NTZ'2024-01-30 00:00:00'"), F.col("user_id"))).alias("d"), F.avg("value").alias("m"), F.max("value").alias("x"), F.max(F.col("ts").cast("timestamp")).alias("newest"))
    age = S.hours_between(F.expr("TIMESTAMP'2024-01-31 00:00:00'"), F.col("newest"))
    return a.select("event_type", F.round(S.breaking(F.col("d"), age, F.col("m"), F.col("x")), 4).alias("signal"))


@query("""WITH d AS (SELECT user_id, count(*) / 30.0 AS per_day FROM events GROUP BY 1) SELECT user_id, CASE WHEN per_day >= 30 THEN 'daily' WHEN per_day >= 10 THEN '2day' WHEN per_day >= 3 THEN 'weekly' WHEN per_day >= 1 THEN 'monthly' ELSE 'skip' END AS cadence FROM d""")
def cadence_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").groupBy("user_id").agg((F.count("*") / 30.0).alias("per_day")).select("user_id", S.cadence(F.col("per_day")).alias("cadence"))


@query("""SELECT CASE WHEN x <= -0.6 THEN 'very_negative' WHEN x <= -0.2 THEN 'negative' WHEN x < 0.2 THEN 'neutral' WHEN x < 0.6 THEN 'positive' ELSE 'very_positive' END AS bucket, count(*) AS n FROM (SELECT least(1, value / 50 - 1) AS x FROM events) GROUP BY 1""")
def sentiment_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.least(F.lit(1.0), F.col("value") / 50 - 1)
    return read(spark, sf_dir, "events").groupBy(S.sentiment_bucket(x).alias("bucket")).agg(F.count("*").alias("n"))


@query("""WITH o AS (SELECT n_regionkey AS org, n_nationkey AS member FROM nation), m AS (SELECT org, count(*) AS members FROM o GROUP BY 1), d AS (SELECT s_nationkey AS nation, count(*) * 1.0 AS w FROM supplier GROUP BY 1), c AS (SELECT n_regionkey AS org, count(*) AS articles FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1),
    x AS (SELECT nation, w FROM d UNION ALL SELECT member, articles * least(0.5, 3.5 / greatest(members, 7)) FROM o JOIN m USING (org) JOIN c USING (org) UNION ALL SELECT c_nationkey, 0.2 * count(*) FROM customer GROUP BY 1) SELECT nation, round(sum(w), 6) AS weight FROM x GROUP BY 1""")
def geographic_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direct, organisation and source evidence added up by nation."""
    n, s, c = (read(spark, sf_dir, t) for t in ("nation", "supplier", "customer"))
    direct = s.groupBy(F.col("s_nationkey").alias("nation")).agg((F.count("*") * 1.0).alias("w"))
    sizes = n.groupBy("n_regionkey").agg(F.count("*").alias("members"))
    articles = c.join(n, c.c_nationkey == n.n_nationkey).groupBy("n_regionkey").agg(F.count("*").alias("articles"))
    shared = n.join(sizes, "n_regionkey").join(articles, "n_regionkey").select(F.col("n_nationkey").alias("nation"), (F.col("articles") * S.member_weight(F.col("members"))).alias("w"))
    source = c.groupBy(F.col("c_nationkey").alias("nation")).agg((0.2 * F.count("*")).alias("w"))
    return direct.unionByName(shared).unionByName(source).groupBy("nation").agg(F.round(F.sum("w"), 6).alias("weight"))


#: Keys of one name that are listed together.
LISTED = 256


@query("""WITH w AS (SELECT a.p_partkey AS a, b.p_partkey AS b, list_distinct(string_split(lower(a.p_name), ' ')) AS x, list_distinct(string_split(lower(b.p_name), ' ')) AS y FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey)
    SELECT a, b, round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))), 6) AS jaccard, round(len(list_intersect(x, y)) / least(len(x), len(y)), 6) AS contained FROM w""")
def name_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jaccard and containment of names inside blocks of brand and size."""
    p = read(spark, sf_dir, "part").select("p_brand", "p_size", "p_partkey", F.array_distinct(F.split(F.lower("p_name"), " ")).alias("w"))
    # the keys of one name in a block, in order, are lists of at most LISTED, and names of a block are compared once
    place = F.row_number().over(Window.partitionBy("p_brand", "p_size", "w").orderBy("p_partkey"))
    lists = p.filter("p_brand IS NOT NULL AND p_size IS NOT NULL").withColumn("list", F.floor((place - 1) / LISTED)).groupBy("p_brand", "p_size", "w", "list").agg(F.sort_array(F.collect_list("p_partkey")).alias("keys"))
    names = materialize(lists, "names")
    kinds = names.select("p_brand", "p_size", "w").distinct()
    # as in SQL a second name that is null shares nothing, and beside a first one that is null nothing is known
    words = [F.col("x"), F.coalesce("y", F.array().cast("array<string>"))]
    told = lambda f: F.when(F.col("x").isNotNull(), F.round(f(*words), 6))
    scores = kinds.withColumnRenamed("w", "x").join(R.shuffled(kinds.withColumnRenamed("w", "y")), ["p_brand", "p_size"]).withColumns({"jaccard": told(T.jaccard), "contained": told(T.containment)})
    alike = lambda c: [F.col(f"s.{k}") == F.col(f"n.{k}") for k in ("p_brand", "p_size")] + [F.col(f"s.{c}").eqNullSafe(F.col("n.w"))]
    met = scores.alias("s").join(R.shuffled(names.alias("n")), alike("y")).select("s.*", F.col("keys").alias("others")).alias("s").join(R.shuffled(names.alias("n")), alike("x"))
    able = met.filter(F.get("keys", F.lit(0)) < F.element_at("others", -1)).select(F.explode("keys").alias("a"), "others", "jaccard", "contained")
    return able.select("a", F.explode("others").alias("b"), "jaccard", "contained").filter("a < b")


@query("""WITH b AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda w: length(w) >= 3) AS ws FROM documents), g AS (SELECT doc_id, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS g FROM b), c AS (SELECT doc_id, g, count(*) AS n FROM g GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, g) AS rn FROM c) SELECT doc_id, g AS bigram, n FROM r WHERE rn <= 10""")
def top_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most frequent bigrams of every document."""
    from presswave.operators.relational import top_k

    g = read(spark, sf_dir, "documents").select("doc_id", F.explode(T.bigrams(T.word_list(F.col("text")))).alias("bigram"))
    return top_k(g.groupBy("doc_id", "bigram").agg(F.count("*").alias("n")), ["doc_id"], [F.desc("n"), F.col("bigram")], 10).select("doc_id", "bigram", "n")


@query("SELECT doc_id, sha256(coalesce(text, '') || '|' || coalesce(source, '')) AS print, regexp_replace(regexp_extract('https://www.' || source || '.example.org/a', '://([^/]+)', 1), '^www\\.', '') AS domain FROM documents")
def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.concat(F.lit("https://www."), F.col("source"), F.lit(".example.org/a"))
    return read(spark, sf_dir, "documents").select("doc_id", T.fingerprint(F.col("text"), F.col("source")).alias("print"), T.domain(url).alias("domain"))


@query("""WITH a AS (SELECT event_type, avg(value) AS m, stddev_pop(value) AS s, count(*) AS n FROM events GROUP BY 1) SELECT event_type, n, round(m, 6) AS mean, round(1 - s / (abs(m) + 0.01), 6) AS confidence FROM a""")
def rule_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = read(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    return a.select("event_type", "n", F.round("m", 6).alias("mean"), F.round(S.rule_confidence(F.col("m"), F.col("s")), 6).alias("confidence"))


@query("""SELECT doc_id, trim(regexp_replace(regexp_replace(strip_accents(replace(lower(coalesce(text, '')), 'ß', ' ')), '[^a-z0-9\\s-]', ' ', 'g'), '\\s+', ' ', 'g')) AS folded, regexp_full_match(coalesce(text, ''), '[\\x00-\\x7F]*') AS ascii FROM documents""")
def folded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts folded to plain letters, and whether they were ASCII."""
    d = read(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    return d.select("doc_id", T.fold("text").alias("folded"), T.is_ascii(F.regexp_replace("text", r"\s", " ")).alias("ascii"))


@query("""WITH c AS (SELECT s_nationkey AS n, p_brand AS k, count(*)::DOUBLE AS w FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey GROUP BY ALL), p AS (SELECT a.n AS a, b.n AS b, k.k FROM (SELECT DISTINCT n FROM c) a JOIN (SELECT DISTINCT n FROM c) b ON a.n < b.n, (SELECT DISTINCT k FROM c) k)
    SELECT p.a, p.b, round(sum(least(coalesce(x.w, 0), coalesce(y.w, 0))) / sum(greatest(coalesce(x.w, 0), coalesce(y.w, 0))), 6) AS similarity FROM p LEFT JOIN c x ON x.n = p.a AND x.k = p.k LEFT JOIN c y ON y.n = p.b AND y.k = p.k GROUP BY ALL""")
def weighted_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted Jaccard of the keyword maps of countries (a few hundred of them)."""
    l, s, p = (read(spark, sf_dir, t) for t in ("lineitem", "supplier", "part"))
    counts = l.join(s, l.l_suppkey == s.s_suppkey).join(p, l.l_partkey == p.p_partkey).groupBy(F.col("s_nationkey").alias("n"), F.col("p_brand").alias("k")).agg(F.count("*").cast("double").alias("w"))
    maps = counts.groupBy("n").agg(F.map_from_entries(F.collect_list(F.struct("k", "w"))).alias("m"))
    pairs = maps.selectExpr("n AS a", "m AS x").join(maps.selectExpr("n AS b", "m AS y"), F.col("a") < F.col("b"))
    return pairs.select("a", "b", F.round(T.weighted_jaccard(F.col("x"), F.col("y")), 6).alias("similarity"))


@query(None)
def diversity_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each day's feed reordered so that sources rest between picks; tested against a brute-force version."""
    e = read(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), "event_id", "user_id", "value")
    return rerank.diversity_rerank(e, "day", "value", "event_id", "user_id")


@query(None)
def variance_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each day's feed reordered so that categories alternate; tested against a brute-force version."""
    e = read(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), "event_id", "event_type", "value", F.col("ts").cast("timestamp").alias("at"))
    return rerank.variance_rerank(e, "day", "value", "event_id", "event_type", "at")


@query(None)
def combined_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each day's feed with sources and categories spread out at once; tested against a brute-force version."""
    e = read(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), "event_id", "user_id", "event_type", "value", F.col("ts").cast("timestamp").alias("at"))
    return rerank.combined_rerank(e, "day", "value", "event_id", "user_id", "event_type", "at")


@query(None)
def ranked_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each day's feed by score with resting sources and spread-out cities; tested on fixtures."""
    e = read(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), "event_id", "user_id", (F.col("user_id") % 9 == 0).alias("city"), "value", F.col("ts").cast("timestamp").alias("at"))
    return rerank.rank_feed(e, "day", "value", "event_id", "user_id", "city", "at")
