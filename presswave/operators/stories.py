"""Merging of story threads that tell one story: threads, and the table that links them to articles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from presswave.functions import text as T
from presswave.functions.expressions import let
from presswave.operators.components import connected_components
from presswave.operators import relational as R
from presswave.operators.lookup import sized
from presswave.operators.names import similar_sets


# From which likeness a story is the same, from which it is worth a look, how many are shown, and days looked back.
SAME, REVIEW, SHOWN, LOOK_BACK = 0.55, 0.28, 5, 60


def identity_candidates(threads: DataFrame, identities: DataFrame, same: float = SAME, review: float = REVIEW, shown: int = SHOWN, days: int = LOOK_BACK) -> DataFrame:
    """id, rank, identity, likeness, verdict: what each thread (id, seen, keys) may be among identities (identity, seen, keys).

    ``keys`` are arrays without repeats, ``seen`` dates; identities last seen within ``days`` before the thread take part, the most alike
    first, then the later seen. From ``same`` on the verdict is same, from ``review`` on review; less alike ones are not shown.
    Equal sets of keys are compared once; a set that many identities share brings its few latest of each day.
    """
    # 128 bits of hash stand for a set, whose text would be shuffled with each of its keys
    told = lambda s: F.unhex(F.substring(F.sha2(F.array_join(s, "\x00"), 256), 1, 32))
    sets = lambda rows: rows.select(F.array_sort("keys").alias("s")).filter(F.size("s") > 0).distinct().withColumn("key", told("s"))
    near = similar_sets(sets(threads), sets(identities), review)
    named = lambda c: told(F.array_sort("keys")).alias(c)
    asked = threads.select("id", "seen", named("a"))
    # of one set, thread and day only the first few identities can be among those shown
    known = R.top_k(identities.select("identity", F.col("seen").alias("last"), named("b")), ["b", "last"], [F.col("identity")], shown + 1)
    days_of = asked.select("a", "seen").distinct().join(R.shuffled(near), "a").join(R.shuffled(known), "b").filter((F.col("last") <= F.col("seen")) & (F.col("last") > F.date_sub("seen", days)))
    best = R.top_k(days_of, ["a", "seen"], [F.desc("sim"), F.desc("last"), F.col("identity")], shown + 1)
    mine = best.join(R.shuffled(asked), ["a", "seen"]).filter("identity != id")
    ranked = R.top_k(mine, ["id"], [F.desc("sim"), F.desc("last"), F.col("identity")], shown, "rank")
    return ranked.select("id", "rank", "identity", F.round("sim", 6).alias("likeness"), F.when(F.col("sim") >= same, "same").otherwise("review").alias("verdict"))


def winners(threads: DataFrame, pairs: DataFrame) -> DataFrame:
    """id, winner, place of every thread of ``pairs`` (a, b): the place in its group by importance, articles, recency, and id; the winner's is 1."""
    parts = connected_components(pairs.selectExpr("a AS u", "b AS v")).select(F.col("node").alias("id"), F.col("component").alias("story"))
    order = Window.partitionBy("story").orderBy(F.desc_nulls_last("importance"), F.desc_nulls_last("article_count"), F.desc_nulls_last("updated"), "id")
    placed = parts.join(R.shuffled(threads.select("id", "importance", "article_count", "updated")), "id").withColumn("place", F.row_number().over(order))
    best = placed.filter("place = 1").select("story", F.col("id").alias("winner"))
    return placed.join(R.shuffled(best), "story").select("id", "winner", "place")


def united(members: DataFrame, values: str, key: Column) -> DataFrame:
    """winner and ``values``: the arrays of a group put together in the order of places; of values with one ``key`` the first stays."""
    each = members.select("winner", "place", F.posexplode(values).alias("pos", "v")).withColumn("k", key)
    first = each.filter("k IS NOT NULL AND k <> ''").groupBy("winner", "k").agg(F.min(F.struct("place", "pos", "v")).alias("f"))
    return first.groupBy("winner").agg(F.transform(F.sort_array(F.collect_list("f")), lambda x: x["v"]).alias(values))


def merge_threads(threads: DataFrame, links: DataFrame, ejections: DataFrame, pairs: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """The tables of threads and of links after the duplicates of ``pairs`` (a, b) are merged.

    ``threads``: id, status, importance, article_count, updated, keywords, nations (arrays); ``links``: thread_id, article_id,
    relevance, is_anchor; ``ejections``: thread_id, article_id.

    The first of each group gets the articles of the others, but for those ejected from it; they are no anchors there, and an
    article that it has, or gets from an earlier one, comes once. It counts its articles anew, unites keywords (one of
    each but for case) and nations, and keeps the greatest importance. The others become dormant and empty.
    """
    members = sized(winners(threads, pairs), "winners")
    out = ejections.select(F.col("thread_id").alias("winner"), F.col("article_id").alias("gone")).distinct()
    told = links.join(members, F.col("thread_id") == F.col("id"), "left")
    kept = told.filter("place IS NULL OR place = 1").select("thread_id", "article_id", F.lit(1).alias("place"), "relevance", "is_anchor")
    lost = told.filter("place > 1").select("winner", F.col("article_id").alias("gone"), "place", "relevance").join(R.shuffled(out), ["winner", "gone"], "left_anti")
    moved = lost.select(F.col("winner").alias("thread_id"), F.col("gone").alias("article_id"), "place", "relevance", F.lit(False).alias("is_anchor"))
    new_links = kept.union(moved).groupBy("thread_id", "article_id").agg(F.min(F.struct("place", F.struct((~F.col("is_anchor")).alias("no"), (-F.col("relevance")).alias("less"), "relevance", "is_anchor").alias("x"))).alias("f")).select("thread_id", "article_id", "f.x.relevance", "f.x.is_anchor")
    counts = new_links.groupBy(F.col("thread_id").alias("id")).agg(F.count("*").alias("n"))
    own = threads.join(members, "id")
    keys = united(own, "keywords", F.lower(F.trim("v"))).withColumnRenamed("keywords", "all_keywords")
    nations = united(own, "nations", F.upper(F.trim("v"))).withColumnRenamed("nations", "all_nations")
    most = own.groupBy("winner").agg(F.max("importance").alias("most"))
    sums = most.join(R.shuffled(keys), "winner", "left").join(R.shuffled(nations), "winner", "left").withColumnRenamed("winner", "id")
    every = threads.join(members.select("id", "place"), "id", "left").join(R.shuffled(sums), "id", "left").join(R.shuffled(counts), "id", "left")
    wins, loses = F.col("place") == 1, F.col("place") > 1
    new_threads = every.select(
        "id",
        F.when(loses, "dormant").otherwise(F.col("status")).alias("status"),
        F.when(wins, F.greatest("importance", "most")).otherwise(F.col("importance")).alias("importance"),
        F.when(loses, F.lit(0)).when(wins, F.coalesce("n", F.lit(0))).otherwise(F.col("article_count")).cast("long").alias("article_count"),
        F.when(F.col("place").isNotNull(), now).otherwise(F.col("updated")).alias("updated"),
        F.when(wins, F.coalesce("all_keywords", "keywords")).otherwise(F.col("keywords")).alias("keywords"),
        F.when(wins, F.coalesce("all_nations", "nations")).otherwise(F.col("nations")).alias("nations"),
    )
    return new_threads, new_links


# Weights of what an article shares with a line and the most of each that count, the least score, and the most candidates and links of a line in a run.
ENTITY, NATION, KEY, TITLE_WORD, PHRASE = 2.5, 2.5, 1.0, 0.4, 2.0
MOST_ENTITIES, MOST_NATIONS, MOST_KEYS = 6, 2, 8
UMBRELLA, CANDIDATES, LINKS = 2.5, 200, 50


def word_runs(text: Column, longest: int) -> Column:
    """The different runs of one to ``longest`` words of a text, in lower case with single spaces."""
    runs = lambda w, n: F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.array_join(F.slice(w, i + 1, n), " "))).otherwise(F.array().cast("array<string>"))
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return let(words, lambda w: F.array_distinct(F.flatten(F.array(*(runs(w, n) for n in range(1, longest + 1))))))


def umbrella_links(lines: DataFrame, articles: DataFrame, attached: DataFrame, since: Column, candidates: int = CANDIDATES, most: int = LINKS) -> DataFrame:
    """line, article, score, by_phrase: the ``most`` best new articles of each line (the feature), ties to the smaller article.

    ``lines``: line, nations, keywords, entities, title (words), phrases (runs of lower-case words): arrays without repeats;
    ``articles``: article, published, nation, keywords, entities, title; ``attached``: line, article pairs that exist.

    Candidates share the nation, a keyword or a phrase of the title; the ``candidates`` newest of each line, published
    ``since`` then and not attached, are scored. One that shares no entity and no phrase is left out, whatever its score. Null
    arrays share nothing. Each branch is an equi-join that is cut to its newest before the branches meet, so a nation of
    a third of all articles costs its rows once.
    """
    longest = lines.select(F.explode("phrases").alias("p")).agg(F.max(F.size(F.split("p", " ")))).first()[0] or 1
    fresh = articles.filter(F.col("published") >= since).withColumn("runs", word_runs(F.col("title"), longest))
    newest = [F.desc("published"), F.col("article")]
    gone = attached.select("line", "article").distinct()

    def branch(of_line: str, of_article: Column) -> DataFrame:
        keys = sized(lines.select("line", F.explode(of_line).alias("k")).distinct(), "keys")
        met = fresh.select("article", "published", of_article.alias("k")).join(keys, "k").select("line", "article", "published").join(gone, ["line", "article"], "left_anti").distinct()
        return R.top_k(met, ["line"], newest, candidates)

    every = branch("nations", F.col("nation")).union(branch("keywords", F.explode("keywords"))).union(branch("phrases", F.explode("runs"))).distinct()
    chosen = R.top_k(every, ["line"], newest, candidates).select("line", "article")
    side = lines.select("line", "nations", *(F.col(c).alias(f"l_{c}") for c in ("keywords", "entities", "title")), "phrases")
    both = chosen.join(side, "line").join(fresh, "article")
    shared = lambda a, b: F.greatest(F.size(F.array_intersect(a, b)), F.lit(0))
    entities, phrase = shared("entities", "l_entities"), F.coalesce(F.arrays_overlap("phrases", "runs"), F.lit(False))
    nations = F.coalesce(F.array_contains("nations", F.col("nation")), F.lit(False)).cast("int")
    words = T.tokens(F.col("title"), 3)
    score = ENTITY * F.least(entities, F.lit(MOST_ENTITIES)) + NATION * F.least(nations, F.lit(MOST_NATIONS)) + KEY * F.least(shared("keywords", "l_keywords"), F.lit(MOST_KEYS)) + TITLE_WORD * shared(words, F.col("l_title")) + F.when(phrase, PHRASE).otherwise(0.0)
    able = both.filter((entities > 0) | phrase).select("line", "article", F.round(score, 6).alias("score"), phrase.alias("by_phrase")).filter(F.col("score") >= UMBRELLA)
    return R.top_k(able, ["line"], [F.desc("score"), F.col("article")], most)
