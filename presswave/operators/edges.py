"""Weighted edges of the thread graph: candidates from capped buckets, sparse vectors met term by term."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswave.functions import text as T
from presswave.operators import relational as R
from presswave.storage import materialize

# Most nodes of a bucket and its boost, by family; least weight of an edge, and edges that each node keeps.
FAMILIES = {"keyword": (90, 1.25), "canonical": (120, 1.5), "native": (90, 1.85), "category": (140, 0.85), "title": (80, 1.15), "identity": (60, 3.0)}
LEAST, EACH, SCALE = 0.26, 12, 10_000  # weights have four digits; halves go up, whatever the order of the sum
KINDS = ("keyword", "canonical", "semantic", "native")


def hinted_pairs(posts: DataFrame, families: Mapping[str, tuple[int, float]] = FAMILIES) -> DataFrame:
    """a, b, hint of the pairs (a < b) of ids that share a bucket (family, key, id): the sum of the boosts of those shared.

    Buckets above their family's cap are no evidence, so a bucket forms at most cap^2 / 2 pairs.
    """
    caps = posts.sparkSession.createDataFrame([(f, most, boost) for f, (most, boost) in families.items()], "family string, most long, boost double")
    rows = posts.select("family", "key", "id").filter("key IS NOT NULL").distinct()
    sizes = rows.groupBy("family", "key").agg(F.count("*").alias("n")).join(F.broadcast(caps), "family")  # one row for each family
    used = sizes.filter("n BETWEEN 2 AND most").select("family", "key", "boost")
    kept = rows.join(used, ["family", "key"])
    pairs = kept.select("family", "key", "boost", F.col("id").alias("a")).join(kept.select("family", "key", F.col("id").alias("b")), ["family", "key"]).filter("a < b")
    return pairs.groupBy("a", "b").agg(F.sum("boost").alias("hint"))


def vector_similarities(pairs: DataFrame, vectors: DataFrame, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """``pairs`` (a, b, ...) with the weighted Jaccard similarity of each kind of ``vectors`` (id, kind, term, weight: not negative).

    Only terms that both sides have are joined: the sum of the greater weights is what both sums leave beside the least ones.
    """
    one = vectors.groupBy("id", "kind", "term").agg(F.sum("weight").alias("weight"))
    sums = one.groupBy("id").agg(*(F.sum(F.when(F.col("kind") == k, F.col("weight"))).alias(k) for k in kinds))
    left = one.select(F.col("id").alias("a"), "kind", "term", F.col("weight").alias("x"))
    right = one.select(F.col("id").alias("b"), "kind", "term", F.col("weight").alias("y"))
    met = pairs.select("a", "b").join(left, "a").join(right, ["b", "kind", "term"])
    least = met.groupBy("a", "b").agg(*(F.sum(F.when(F.col("kind") == k, F.least("x", "y"))).alias(f"s_{k}") for k in kinds))
    side = lambda s: sums.select(F.col("id").alias(s), *(F.col(k).alias(f"{s}_{k}") for k in kinds))
    all_ = pairs.join(least, ["a", "b"], "left").join(side("a"), "a", "left").join(side("b"), "b", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    similar = {k: F.coalesce(F.try_divide(zero(f"s_{k}"), zero(f"a_{k}") + zero(f"b_{k}") - zero(f"s_{k}")), F.lit(0.0)) for k in kinds}
    return all_.select(*pairs.columns, *(v.alias(f"sim_{k}") for k, v in similar.items()))


def edge_weights(threads: DataFrame, vectors: DataFrame, posts: DataFrame, least: float = LEAST, each: int = EACH) -> DataFrame:
    """a, b, weight of the edges among ``threads`` of at least ``least``, of which each node keeps its ``each`` heaviest (ties to the smaller ids).

    ``threads``: id, category, importance, article_count, raw_hits, normalized_hits, identity, and the arrays countries,
    languages, title, summary (without repeats). ``vectors``: see ``vector_similarities``; ``posts``: see ``hinted_pairs``.
    """
    pairs = vector_similarities(materialize(hinted_pairs(posts), "pairs"), vectors)
    names = [c for c in threads.columns if c != "id"]
    side = lambda s: threads.select(F.col("id").alias(s), *(F.col(c).alias(f"{s}_{c}") for c in names))
    p = pairs.join(side("a"), "a").join(side("b"), "b")
    both = lambda c: (F.col(f"a_{c}"), F.col(f"b_{c}"))
    overlap = lambda c: T.jaccard(*both(c))
    same = lambda c: F.coalesce(F.col(f"a_{c}") == F.col(f"b_{c}"), F.lit(False))
    at_least = lambda c, n: (F.col(f"a_{c}") >= n) & (F.col(f"b_{c}") >= n)
    share = lambda s: F.col(f"{s}_raw_hits") / F.greatest(F.lit(1), F.col(f"{s}_raw_hits") + F.col(f"{s}_normalized_hits"))
    foreign = (share("a") + share("b")) / 2
    kw, canon, sem, native = (F.col(f"sim_{k}") for k in KINDS)
    gain = lambda when, much: F.when(F.coalesce(when, F.lit(False)), F.lit(much)).otherwise(0.0)
    bonus: Column = (
        gain(at_least("importance", 8) & same("category"), 0.03)
        + gain(at_least("article_count", 12) & (overlap("summary") >= 0.12), 0.025)
        + gain(overlap("countries") >= 0.34, 0.02)
        + gain(sem >= 0.22, 0.015)
        + gain(native >= 0.18, 0.04)
        + gain((canon >= 0.25) & (foreign >= 0.4), 0.03)
    )
    total = (
        0.28 * F.greatest(kw, canon)
        + 0.22 * F.greatest(native, canon * foreign)
        + 0.12 * sem
        + 0.08 * kw
        + 0.12 * same("category").cast("int")
        + 0.09 * overlap("countries")
        + 0.05 * overlap("languages")
        + 0.13 * F.greatest(overlap("title"), overlap("summary"), same("identity").cast("double"))
        + bonus
        + F.least(F.lit(0.10), 0.012 * F.col("hint"))
    )
    edges = materialize(p.select("a", "b", (F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)) * SCALE + 0.5 + 1e-6) / SCALE).alias("weight")).filter(F.col("weight") >= least), "edges")
    ends = edges.select(F.col("a").alias("node"), "a", "b", "weight").union(edges.select(F.col("b").alias("node"), "a", "b", "weight"))
    return R.top_k(ends, ["node"], [F.desc("weight"), F.col("a"), F.col("b")], each).select("a", "b", "weight").distinct()
