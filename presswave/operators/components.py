"""Connected components of an edge list by alternating large-star and small-star steps.

Every step is a grouped minimum (partial aggregates on the map side) joined back to the edges, so a hub is
a skewed join key that AQE splits, and no component is gathered anywhere. Each round is one job: it is
written to the shared folder, and the write itself observes whether anything changed. The plan stays short
and a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from presswave.storage import materialize


def _starred(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over edges (u, v)."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
    small = large.groupBy("u").agg(F.min("v").alias("m"))
    pairs = large.join(small, "u")
    return pairs.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).distinct()


def _stars(edges: DataFrame, max_rounds: int) -> DataFrame:
    """node, component for every node of ``edges`` (u, v: not null, not equal) that is not the least of its component."""
    now, seen = edges, None
    for _ in range(max_rounds):
        told = Observation()
        now = materialize(_starred(now).observe(told, F.count("*").alias("n"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40))).alias("h")), "stars")
        state = (told.get["n"], told.get["h"])
        if state == seen or state[0] == 0:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        seen = state
    raise RuntimeError(f"no fixpoint after {max_rounds} rounds")


def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """node, component (its least node) for every node of ``edges`` (u, v: comparable, e.g. long).

    Self-loops, repeated and reversed edges are allowed; edges with a null end are ignored. Nodes that have
    only self-loops are their own component. Raises if ``max_rounds`` do not reach the fixpoint.
    """
    edges = materialize(edges.select("u", "v").filter("u IS NOT NULL AND v IS NOT NULL").distinct(), "edges")
    stars = _stars(edges.filter("u != v"), max_rounds)
    loops = edges.filter("u = v").select(F.col("u").alias("node")).join(stars.select("node"), "node", "left_anti")
    return stars.union(stars.select("component").union(loops).distinct().select(F.col("component").alias("node"), "component"))


def extended_components(labels: DataFrame, edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """``labels`` (node, component) after further ``edges`` (u, v) between their nodes.

    The edges are first moved to the components they connect, so only what is new is worked through. A node
    that has no label is its own component.
    """
    ends = edges.select("u", "v")
    for end in ("u", "v"):
        ends = ends.join(labels.select(F.col("node").alias(end), F.col("component").alias(f"c{end}")), end, "left")
    moved = ends.select(F.coalesce("cu", "u").alias("u"), F.coalesce("cv", "v").alias("v")).filter("u != v")
    stars = _stars(materialize(moved.distinct(), "edges"), max_rounds)
    kept = labels.join(stars.select(F.col("node").alias("component"), F.col("component").alias("into")), "component", "left").select("node", F.coalesce("into", "component").alias("component"))
    every = stars.union(stars.select("component", "component"))
    fresh = every.distinct().join(labels.select("node"), "node", "left_anti")
    return materialize(kept.union(fresh), "components")
