"""Relational building blocks: top-k, arg-max, band and blocked self-joins, upserts as frames.

All are compositions of built-in operators. Windows carry a full tie-break so results are deterministic.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` marked to meet others by sort and merge.

    Spark takes a frame for as large as the stored columns it comes from. Where rows are exploded, or long arrays are made
    from short columns, that is far too small, and a side broadcast by it may not fit the driver.
    """
    return df.hint("merge")


def top_k(df: DataFrame, by: Sequence[str | Column], order: Sequence[Column], k: int, rank: str | None = None) -> DataFrame:
    """The first ``k`` rows of each group; Spark prunes with a group limit before the shuffle."""
    name = rank or "__rank"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(name) <= k)
    return out if rank else out.drop(name)


def distinct_on(df: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key: the first in ``order``."""
    return top_k(df, by, order, 1)


def ordered_list(value: str, *order: Column) -> Column:
    """Aggregate: the values in an order."""
    return F.transform(F.sort_array(F.collect_list(F.struct(*(c.alias(f"o{k}") for k, c in enumerate(order)), F.col(value).alias("v")))), lambda s: s["v"])


def band_join(left: DataFrame, right: DataFrame, at: str, other: str, width: int, on: Sequence[str] = ()) -> DataFrame:
    """Pairs whose numbers ``at`` and ``other`` differ by ``width`` at most, with equal ``on`` columns.

    The left side is hashed to its bucket, the right side to its bucket and both neighbours, so the join
    is an equi-join that shuffles on (on, bucket).
    """
    bucket = lambda c: F.floor(F.col(c) / width)
    a = left.withColumn("__bucket", bucket(at))
    b = right.withColumn("__bucket", F.explode(F.sequence(bucket(other) - 1, bucket(other) + 1)))
    return a.join(b, [*on, "__bucket"]).filter(F.abs(F.col(at) - F.col(other)) <= width).drop("__bucket")


def blocked_pairs(keys: DataFrame, node: str, key: str, least: int, most: int, at_least: int = 1, boost: str | None = None) -> DataFrame:
    """Pairs (a < b) of nodes that share keys, with the number (or sum of boosts) of those they share.

    Keys held by fewer than ``least`` or more than ``most`` nodes are no evidence and are left out before
    the self-join, which bounds its rows by ``most`` per posting.
    """
    posts = keys.select(F.col(node).alias("n"), F.col(key).alias("k"), (F.col(boost) if boost else F.lit(1)).alias("w")).distinct()
    used = posts.groupBy("k").count().filter(F.col("count").between(max(2, least), most)).select("k")
    posts = posts.join(used, "k")
    pairs = posts.selectExpr("k", "n AS a", "w").join(posts.selectExpr("k", "n AS b"), "k").filter("a < b")
    return pairs.groupBy("a", "b").agg(F.sum("w").alias("shared")).filter(F.col("shared") >= at_least)


def first_of(pools: Sequence[DataFrame], by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """A fallback chain: each key's row from the first pool that has it."""
    every = None
    for k, pool in enumerate(pools):
        one = pool.withColumn("__pool", F.lit(k))
        every = one if every is None else every.unionByName(one)
    return top_k(every, by, [F.col("__pool"), *order], 1).drop("__pool")


def insert_ignore(existing: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``existing`` and those rows of ``new`` whose key it lacks."""
    return existing.unionByName(new.join(existing.select(*keys), list(keys), "left_anti").select(*existing.columns))


def upsert(existing: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[Column] = ()) -> DataFrame:
    """Rows of ``new`` replace those of ``existing`` with the same key."""
    both = existing.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    return top_k(both, keys, [F.col("__new").desc(), *order], 1).drop("__new")


def increment(existing: DataFrame, new: DataFrame, keys: Sequence[str], counters: Sequence[str]) -> DataFrame:
    """Counters of equal keys added up."""
    return existing.unionByName(new).groupBy(*keys).agg(*(F.sum(c).alias(c) for c in counters))


def update_from(target: DataFrame, changes: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """``target`` with columns taken from ``changes`` where it has the key."""
    renamed = changes.select(*keys, *(F.col(c).alias(f"__{c}") for c in columns))
    joined = target.join(renamed, list(keys), "left")
    return joined.withColumns({c: F.coalesce(f"__{c}", c) for c in columns}).select(*target.columns)


def keep_newest(df: DataFrame, by: Sequence[str], order: Sequence[Column], most: int) -> DataFrame:
    """What a snapshot cache keeps: the newest ``most`` rows of each key."""
    return top_k(df, by, order, most)


def refreshed_counts(parents: DataFrame, children: DataFrame, key: str, count: str) -> DataFrame:
    """Parents with the number of their children (0 for none)."""
    return parents.join(children.groupBy(key).agg(F.count("*").alias(count)), key, "left").withColumn(count, F.coalesce(count, F.lit(0)))


def round_robin(df: DataFrame, by: str, order: Sequence[Column]) -> DataFrame:
    """Rows with ``turn`` and sorted so that groups take turns."""
    return df.withColumn("turn", F.row_number().over(Window.partitionBy(by).orderBy(*order))).orderBy("turn", by)
