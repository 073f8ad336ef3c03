"""Nearest neighbours by a permutation index.

A bounded sample gives the pivots, about ``4 * sqrt(rows)`` of them. A vector is represented by the order in
which it sees its ``PLACES`` nearest pivots, and is posted with its place in the inverted file of each. A
query opens the files of its own nearest pivots; the places met there give the footrule distance of the two
orders (a pivot outside an order has the place after its last). The best share of a block by footrule is
reranked by the exact cosine in double precision; the share falls with the fourth root of the rows.

The index is cut into blocks of about ``BLOCK`` vectors, each with its own inverted files, and the queries
into parts of about ``BLOCK``; a block and a part meet in one small task group, so no group grows with the
input, whatever vector or id is common, and a vector is sent once for each part, not once for each file.

Rows: vectors that are null, zero, empty, of another length than the commonest, or hold a null or non-finite
number take no part (of equally common lengths the shorter counts). Rows with a null id take no part. Rows
that repeat a vec_id are rows of their own, but rows that repeat id and vector are one query; a query does
not find rows with its own id. Equal scores go to the smaller vec_id. Extra columns are ignored. An empty
table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from presswave.functions.expressions import let
from presswave.storage import materialize

SAMPLE, MOST_PIVOTS, PLACES = 4096, 2048, 32
BLOCK = 4096
#: Of a block's vectors: least number reranked, and the share at 10,000 rows, which falls with the fourth root of the rows.
LEAST, SHARE = 64, 0.2
FOUND = pa.schema([("query_id", pa.int64()), ("query", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
PARTS = 1 << 40
#: Largest components of doubles whose squares and their sums stay in range.
SAFE = (2.0**-400, 2.0**400)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and v (floats as they are, else doubles) of the rows that take part.

    Doubles whose squares could leave the range of doubles are divided by a power of two, which leaves every cosine as it is.
    """
    kind = vectors.schema["embedding"].dataType
    floats = isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType)
    v = F.col("embedding") if floats else F.col("embedding").cast("array<double>")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & good)
    if floats:
        return rows
    most = F.array_max(F.transform("v", F.abs))
    scaled = let(F.pow(F.lit(2.0), F.floor(F.log2(most))), lambda unit: F.transform("v", lambda x: x / unit))
    return rows.withColumn("v", F.when(most.between(*SAFE), F.col("v")).otherwise(scaled))


def pick_pivots(rows: DataFrame, count: int, sample: int = SAMPLE) -> np.ndarray:
    """Unit vectors of at most ``sqrt(count) * 4`` different rows, of about ``sample`` rows with the least hash."""
    h = F.pmod(F.xxhash64("vec_id", "v"), F.lit(PARTS))
    below = PARTS if count <= sample else PARTS * sample // count
    taken = rows.select("v", h.alias("h")).filter(F.col("h") < below).distinct().collect()
    told = dict.fromkeys(tuple(r["v"]) for r in sorted(taken, key=lambda r: r["h"]))
    x = np.array(list(told)[: min(MOST_PIVOTS, max(32, int(4 * count**0.5)))], dtype=float)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def nearest_pivots(pivots: np.ndarray, places: int):
    """A pandas UDF: the numbers of a vector's nearest pivots in order."""

    @F.pandas_udf("array<int>")
    def udf(v: pd.Series) -> pd.Series:
        if not len(v):
            return pd.Series([], dtype=object)
        near = -(np.stack(v.to_list()).astype(float) @ pivots.T)
        some = np.argpartition(near, places - 1, axis=1)[:, :places] if places < len(pivots) else np.arange(len(pivots))[None, :].repeat(len(near), 0)
        some.sort(axis=1)
        order = np.argsort(np.take_along_axis(near, some, 1), axis=1, kind="stable")
        return pd.Series(list(np.take_along_axis(some, order, 1).astype(np.int32)))

    return udf


def matrix(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    """An Arrow column of arrays of one length as a matrix."""
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(kind)
    return flat.reshape(len(column), -1)


class Block:
    """The inverted files of a block of vectors: of each pivot the rows posted there and their places."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, orders: np.ndarray, pivots: int) -> None:
        by_id = np.argsort(ids, kind="stable")
        self.ids, self.x, orders = ids[by_id], vectors[by_id], orders[by_id]
        self.norms, self.places = np.sqrt((self.x * self.x).sum(axis=1)), orders.shape[1]
        posted = np.argsort(orders.ravel(), kind="stable")
        self.rows, self.place = posted // self.places, posted % self.places
        self.starts = np.searchsorted(orders.ravel()[posted], np.arange(pivots + 1))

    def nearer(self, order: np.ndarray) -> np.ndarray:
        """By how much less than the greatest the footrule distance of each vector from ``order`` is.

        It is the sum of 2 * (places - the later of the two places) over the pivots both orders have.
        """
        spans = [slice(i, j) for i, j in zip(self.starts[order], self.starts[order + 1], strict=True)]
        mine = np.repeat(np.arange(len(order)), [s.stop - s.start for s in spans])
        rows, theirs = (np.concatenate([x[s] for s in spans]) for x in (self.rows, self.place))
        return np.bincount(rows, 2.0 * (self.places - np.maximum(mine, theirs)), len(self.ids))

    def search(self, name: int, vector: np.ndarray, order: np.ndarray, k: int, reranked: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and cosines of the best of the ``reranked`` vectors that are first by footrule."""
        near = self.nearer(order)
        near[self.ids == name] = -1
        best = np.argsort(-near.astype(np.int16), kind="stable")[:reranked]
        best = best[near[best] >= 0]
        score = (self.x[best] * vector).sum(axis=1) / (self.norms[best] * np.sqrt((vector * vector).sum()))
        top = np.lexsort((self.ids[best], -score))[:k]
        return self.ids[best][top], score[top]


def search(vectors: DataFrame, is_query: Column, k: int = 5, places: int = PLACES, share: float = SHARE) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of each query, nearest first."""
    rows = materialize(usable(vectors), "vectors")
    length = rows.groupBy(F.size("v").alias("length")).count().orderBy(F.desc("count"), "length").first()
    if length is None:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    count, rows = length["count"], rows.filter(F.size("v") == length["length"])
    pivots = pick_pivots(rows, count)
    m, places = len(pivots), min(places, len(pivots))
    part = min(1.0, share * (10_000 / count) ** 0.25)
    queries = materialize(rows.filter(is_query).distinct(), "queries")
    blocks, parts = -(-count // BLOCK), max(1, -(-queries.count() // BLOCK))
    order, spread = nearest_pivots(pivots, places), F.xxhash64("vec_id", F.monotonically_increasing_id())
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.select(F.pmod(spread, F.lit(blocks)).cast("int").alias("block"), "vec_id", "v", order("v").alias("o")).withColumn("part", every(parts))
    right = queries.select(F.pmod(spread, F.lit(parts)).cast("int").alias("part"), "vec_id", "v", order("v").alias("o"), F.xxhash64("v").alias("query")).withColumn("block", every(blocks))

    def meet(index: pa.Table, asked: pa.Table) -> pa.Table:
        if not len(index) or not len(asked):
            return FOUND.empty_table()
        block = Block(index["vec_id"].to_numpy(), matrix(index["v"], float), matrix(index["o"], np.int64), m)
        reranked, out = max(LEAST, int(np.ceil(part * len(index)))), []
        for name, query, v, o in zip(asked["vec_id"].to_numpy(), asked["query"].to_numpy(), matrix(asked["v"], float), matrix(asked["o"], np.int64), strict=True):
            ids, score = block.search(name, v, o, k, reranked)
            out.append((np.full(len(ids), name), np.full(len(ids), query), ids, score))
        return pa.Table.from_arrays([pa.array(np.concatenate(x), t) for x, t in zip(zip(*out, strict=True), FOUND.types, strict=True)], schema=FOUND)

    found = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(meet, "query_id long, query long, vec_id long, score double")
    nearest = Window.partitionBy("query_id", "query").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(nearest)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
