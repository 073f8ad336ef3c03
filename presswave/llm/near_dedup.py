"""Near-duplicate detection: BagMinHash signatures, banding, and exact verification of multiset overlap.

A text is the multiset of its five-word shingles (words: runs of letters, digits and underscores, lower
case; a shorter text is one shingle). BagMinHash: each shingle owns one Poisson process per dyadic range of weights
([0,1), [1,2), [2,4), ...), so a larger weight only adds processes and points; a point of a process has a
time, a weight level and a signature position, and counts if its level is below the shingle's weight. The
signature keeps the first time at each position, so two positions agree with the probability of the
weighted Jaccard similarity. Points come in time order and stop once they are later than all positions.

Bands of the signature propose pairs; every link is verified on the whole multisets (as sets whose elements
are a shingle and the number of its use, so that built-in array functions count the overlap). Texts with the
same words are one class from the start, so copies are never paired. Pairs come in rounds:

1. each class with the least class it shares a bucket with;
2. ``ROUNDS`` times, in each bucket, a random class of every component with one of the largest component;
3. the classes of buckets that still hold several components, by a prefix filter that is exact: a class's
   shingles are ordered from the rarest, those that no other component has come first and are not posted, and
   two classes meet only at a shingle so near the front of both that the threshold is still in reach there,
   and only if the parities of their elements over ``BITS`` buckets do not differ in more places than the
   threshold lets the sets differ. Before their bags meet, parities over ``WIDE`` buckets for each element tell
   nearly all pairs below the threshold.

A pair of one component is never formed in the last step, so a large group of near copies costs about its
size; two classes of different components meet only where they share a shingle that few others have or are
nearly alike. So every pair that shares a bucket is verified, already connected, or proved to be below
the threshold, without a cap.

Rows: null and empty texts, and texts without words, are near no other text: each keeps its own class.
Rows that repeat a doc_id are rows of their own; rows that agree in all columns are one row repeated and share
``kept``. Extra columns are ignored. An empty table gives an empty result. class_id is the least doc_id of
the class (null if it has none). Very long texts are hashed and signed in blocks.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presswave.functions.expressions import row_key
from presswave.llm.lookup import slices
from presswave.operators.components import connected_components, extended_components
from presswave.storage import materialize

WORDS, THRESHOLD = 5, 0.8
BANDS, ROWS, ROUNDS = 32, 5, 2
#: Characters hashed and processes signed at once.
BLOCK, PROCESSES = 1 << 19, 1 << 17
#: Buckets of elements whose parities are compared (a multiple of 64).
BITS = 512
#: Buckets for each element of the parities that candidates are compared by before their bags meet.
WIDE = 8
U = np.uint64
GOLD, M1, M2, PRIME = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB), U(0x100000001B3)


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser."""
    x = (x ^ (x >> U(30))) * M1
    x = (x ^ (x >> U(27))) * M2
    return x ^ (x >> U(31))


@lru_cache(1)
def alphabet() -> tuple[np.ndarray, np.ndarray]:
    """Whether each character belongs to words, and a random number for it."""
    inside = np.fromiter((c.isalnum() or c == "_" for c in map(chr, range(0x110000))), bool, 0x110000)
    return inside, mix(np.arange(0x110000, dtype=U) * GOLD + U(1))


@lru_cache(2)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2^64."""
    base = 0x9E3779B97F4A7C15
    up, down = np.full(n, base, U), np.full(n, pow(base, -1, 1 << 64), U)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def cut(text: str) -> Iterator[str]:
    """Parts of a text of about ``BLOCK`` characters that do not split words (a longer word stays whole)."""
    begin = 0
    while len(text) - begin > BLOCK:
        end = re.compile(r"\W").search(text, begin + BLOCK)
        if end is None:
            break
        yield text[begin : end.start()]
        begin = end.start()
    yield text[begin:]


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the lower-cased texts in order, and each text's first word's number (one more at the end)."""
    lowered = [x.lower() for x in texts]
    inside, random = alphabet()
    codes = np.frombuffer("\n".join([*lowered, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    word = np.concatenate([[False], inside[codes], [False]])
    edges = np.flatnonzero(word[1:] != word[:-1])
    starts, ends = edges[::2], edges[1::2]
    up, down = powers(1 << max(16, int(len(codes)).bit_length()))
    total = np.concatenate([np.zeros(1, U), np.cumsum(random[codes] * up[: len(codes)])])
    hashes = mix((total[ends] - total[starts]) * down[starts])
    first = np.concatenate([[0], np.cumsum([len(x) + 1 for x in lowered])]).astype(np.int64)
    return hashes, np.searchsorted(starts, first)


def shingle_bags(texts: list[str], size: int = WORDS) -> list[tuple[np.ndarray, np.ndarray, bytes]]:
    """Distinct shingle hashes, their counts, and a digest of the sequence of words, of each text."""
    parts = [list(cut(x)) for x in texts]
    if max(map(len, parts), default=1) > 1:
        hashes = [np.concatenate([word_hashes([x])[0] for x in p]) for p in parts]
        h, at = np.concatenate(hashes), np.concatenate([[0], np.cumsum(list(map(len, hashes)))])
    else:
        h, at = word_hashes(texts)
    rolled = np.zeros(max(0, len(h) - size + 1), U)
    for k in range(size):
        rolled = mix(rolled * PRIME + h[k : len(h) - size + 1 + k]) if len(rolled) else rolled
    out = []
    for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if i == j:
            out.append((np.empty(0, U), np.empty(0, np.int64), b""))
            continue
        if j - i >= size:
            s = rolled[i : j - size + 1]
        else:
            s = np.zeros(1, U)
            for k in range(i, j):
                s = mix(s * PRIME + h[k : k + 1])
        out.append((*np.unique(s, return_counts=True), hashlib.md5(h[i:j].tobytes(), usedforsecurity=False).digest()))
    return out


def bag_minhash(bags: list[tuple], size: int) -> np.ndarray:
    """First times at ``size`` positions for each of several non-empty multisets."""
    doc = np.repeat(np.arange(len(bags)), [len(x[0]) for x in bags])
    values, counts = np.concatenate([x[0] for x in bags]), np.concatenate([x[1] for x in bags])
    first, low, most = np.full(len(bags) * size, np.inf), 0, int(counts.max())
    # points for each process in one step: enough to fill the positions of most of the smallest multisets
    block = int(size * (np.log(size) + 1) / min(len(x[0]) for x in bags)) + 2
    while low < most:  # the processes of [0, 1), then of [1, 2), [2, 4) ...
        have = np.flatnonzero(counts > low)
        for k in range(0, len(have), PROCESSES):
            some = have[k : k + PROCESSES]
            seed = values[some] if not low else mix(values[some] + np.full(1, low, U) * GOLD)
            _run_processes(first, seed, low, counts[some], doc[some], size, block)
        low = 2 * low or 1
    return first.reshape(-1, size)


def _run_processes(first: np.ndarray, seed: np.ndarray, low: int, weight: np.ndarray, owner: np.ndarray, size: int, block: int) -> None:
    """Lower ``first`` by the points of processes over the weights from ``low`` to twice it (0: to 1)."""
    width, time, begin = max(low, 1), np.zeros(len(seed)), 0
    while len(seed):
        step = np.arange(begin, begin + block, dtype=np.uint64) * U(2)
        a = mix(seed[:, None] + (step + U(1)) * GOLD)
        b = mix(seed[:, None] + (step + U(2)) * GOLD)
        at = time[:, None] - np.cumsum(np.log1p((a >> U(11)) * -(2.0**-53)) / width, axis=1)
        place = ((b >> U(32)) * U(size) >> U(32)).astype(np.int64) + owner[:, None] * size
        if low:
            height = low + (((b & U(0xFFFFFFFF)) * U(width)) >> U(32)).astype(np.int64)
            counted = height < weight[:, None]
            np.minimum.at(first, place[counted], at[counted])
        else:
            np.minimum.at(first, place.ravel(), at.ravel())
        time = at[:, -1]
        on = time < first.reshape(-1, size).max(axis=1)[owner]
        seed, weight, owner, time = seed[on], weight[on], owner[on], time[on]
        begin += block


def band_keys(signatures: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    bits = signatures.view(U).reshape(len(signatures), bands, rows)
    key = np.tile(np.arange(bands, dtype=U), (len(signatures), 1))
    for k in range(rows):
        key = mix(key * PRIME + bits[:, :, k])
    return key.view(np.int64)


def all_band_keys(bags: list[tuple], points: int = 1 << 15) -> list[np.ndarray | None]:
    """Band keys of each multiset (None if empty); multisets of similar size are signed together."""
    out: list[np.ndarray | None] = [None] * len(bags)
    order = [k for k in sorted(range(len(bags)), key=lambda k: len(bags[k][0])) if len(bags[k][0])]
    while order:
        n, k = len(bags[order[0]][0]), 1
        while k < len(order) and k * n < points // 8 and len(bags[order[k]][0]) <= n * 5 // 4:
            k += 1
        for j, keys in zip(order[:k], band_keys(bag_minhash([bags[j] for j in order[:k]], BANDS * ROWS)), strict=True):
            out[j] = keys
        order = order[k:]
    return out


def elements(bag: tuple) -> np.ndarray:
    """The multiset as a set: a number for each shingle and use of it (the first use: the shingle's)."""
    shingles, counts = bag[0], bag[1]
    if len(counts) == 0 or counts.max() == 1:
        return shingles.view(np.int64)
    nth = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    every = np.repeat(shingles, counts)
    return np.where(nth == 0, every, mix(every ^ mix(nth.astype(U) + GOLD))).view(np.int64)


def parities(elements: np.ndarray, width: int = BITS) -> np.ndarray:
    """Whether each of ``width`` buckets holds an odd number of elements, packed: two sets differ in at least as many elements as bits."""
    odd = np.bincount((mix(elements.view(U)) % U(width)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(bool)).view(np.int64)


def wide_parities(elements: np.ndarray) -> np.ndarray:
    """Parities over at least ``WIDE`` buckets for each element, a power of two of them."""
    return parities(elements, max(BITS, 1 << (WIDE * len(elements) - 1).bit_length()))


def lists(rows: list[np.ndarray | None], kind: pa.DataType) -> pa.Array:
    """An Arrow array of arrays (None: null)."""
    sizes = [0 if x is None else len(x) for x in rows]
    ends = np.cumsum([0, *sizes]).astype(np.int32)
    flat = np.concatenate([x for x in rows if x is not None and len(x)]) if sum(sizes) else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, kind), mask=pa.array([x is None for x in rows]))


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, key, words (digest; null without words), n (shingles), bands for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", BLOCK):
            bags = shingle_bags(part.column(2).to_pylist())
            words, n = pa.array([x[2] or None for x in bags], pa.binary()), pa.array([int(x[1].sum()) for x in bags], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), words, n, lists(all_band_keys(bags), pa.int64())], ["doc_id", "key", "words", "n", "bands"])

    rows = docs.select("doc_id", row_key(docs).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, key string, words binary, n long, bands array<long>")


def bagged(texts: DataFrame) -> DataFrame:
    """node, bag (the multiset's elements), bits and wide (their parities), size of each (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", BLOCK):
            bags = [elements(x) for x in shingle_bags(part.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([part.column(0), lists(bags, pa.int64()), lists(list(map(parities, bags)), pa.int64()), lists(list(map(wide_parities, bags)), pa.int64()), pa.array(list(map(len, bags)), pa.int64())], ["node", "bag", "bits", "wide", "size"])

    return texts.select("node", "text").mapInArrow(run, "node long, bag array<long>, bits array<long>, wide array<long>, size long")


def not_apart(pairs: DataFrame, bags: DataFrame, threshold: float) -> DataFrame:
    """The pairs (u, v) whose wide parities leave room for the threshold; an eighth of the bags' bytes tells.

    The wider of two is folded: bucket k and k + w / 2 are one bucket of half the width w. Sizes within the threshold are one
    width or two next to each other; where they are further apart the pair is not similar.
    """
    side = lambda s: bags.select(F.col("node").alias(s), F.col("size").alias(f"n{s}"), F.col("wide").alias(f"w{s}"))
    met = pairs.select("u", "v").join(side("u"), "u").join(side("v"), "v")
    xor = lambda a, b: F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y))
    half = lambda a: xor(F.slice(a, F.lit(1), (F.size(a) / 2).cast("int")), F.slice(a, (F.size(a) / 2).cast("int") + 1, (F.size(a) / 2).cast("int")))
    wu, wv = F.col("wu"), F.col("wv")
    met = met.filter(alike("nu", "nv", threshold)).select("u", "v", (F.col("nu") + F.col("nv")).alias("sum"), F.when(F.size(wu) > F.size(wv), half(wu)).otherwise(wu).alias("a"), F.when(F.size(wv) > F.size(wu), half(wv)).otherwise(wv).alias("b"))
    apart = F.aggregate(xor(F.col("a"), F.col("b")), F.lit(0), lambda t, x: t + F.bit_count(x))
    return met.filter(F.col("sum") - apart >= 2 * threshold / (1 + threshold) * F.col("sum") - 1e-6).select("u", "v")


def verified(pairs: DataFrame, bags: DataFrame, threshold: float) -> DataFrame:
    """The pairs (u, v) whose bags have a similarity of ``threshold`` or more."""
    right = pairs.select("u", "v").join(bags.select(F.col("node").alias("v"), F.col("bag").alias("b")), "v")
    full = right.join(bags.select(F.col("node").alias("u"), F.col("bag").alias("a")), "u")
    both = full.select("u", "v", F.size(F.array_intersect("a", "b")).alias("both"), (F.size("a") + F.size("b")).alias("sum"))
    return both.filter(F.col("both") / (F.col("sum") - F.col("both")) >= threshold).select("u", "v")


def alike(n: str, m: str, threshold: float):
    """Whether sizes allow the threshold."""
    return (F.col(n) >= threshold * F.col(m) - 1e-6) & (F.col(m) >= threshold * F.col(n) - 1e-6)


def split_buckets(members: DataFrame, labels: DataFrame) -> DataFrame:
    """key, node, n, component of the buckets that hold several components."""
    placed = members.select("key", "node", "n").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    split = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high")
    return placed.join(split.select("key"), "key")


def random_pairs(left: DataFrame, nth: int, threshold: float) -> DataFrame:
    """In each bucket a random class of every component with one of the largest component."""
    pick = F.struct(F.xxhash64("node", "key", F.lit(nth)).alias("h"), "node", "n")
    ones = left.groupBy("key", "component").agg(F.count("*").alias("times"), F.min(pick).alias("d"))
    hubs = ones.groupBy("key").agg(F.max(F.struct("times", "component", "d")).alias("hub"))
    pairs = ones.join(hubs, "key").filter("component != hub.component").select(
        F.least("d.node", "hub.d.node").alias("u"), F.greatest("d.node", "hub.d.node").alias("v"), F.col("d.n").alias("n"), F.col("hub.d.n").alias("m")
    )
    return pairs.filter(alike("n", "m", threshold)).select("u", "v").distinct()


def prefix_posts(left: DataFrame, bags: DataFrame, threshold: float) -> DataFrame:
    """s, node, n, ahead, component, indexed, bits: the front elements at which a class of ``left`` can meet another component's.

    Elements are ordered by (number of classes, element) after those that one component has alone; ``ahead``
    counts the elements before. A pair's first common element leaves at most n - ahead for the overlap, which
    has to be t / (1 + t) * (n + m). ``indexed`` are those that a partner of the same size or larger can meet.
    """
    share = threshold / (1 + threshold)
    nodes = left.select("node", "n", "component").distinct()
    every = nodes.join(bags, "node").select("node", "n", "component", F.explode("bag").alias("s"))
    held = every.groupBy("s").agg(F.count("*").alias("df"), F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high")
    shared = every.join(held.select("s", "df"), "s").groupBy("node", "n", "component").agg(F.array_sort(F.collect_list(F.struct("df", "s"))).alias("front"))
    own = F.col("n") - F.size("front")
    reach = F.floor(F.col("n") * (1 - threshold) + 1e-6).cast("int") + 1 - own  # elements whose ``ahead`` is in reach
    posts = shared.withColumn("own", own).filter(reach > 0).select("node", "n", "component", "own", F.posexplode(F.slice("front", 1, reach.cast("int"))).alias("i", "e"))
    ahead = (F.col("own") + F.col("i")).alias("ahead")
    placed = posts.select("e.s", "node", "n", ahead, "component", (F.col("n") - F.col("own") - F.col("i") >= 2 * share * F.col("n") - 1e-6).alias("indexed"))
    return placed.join(bags.select("node", "bits"), "node")


def prefix_pairs(posts: DataFrame, threshold: float) -> DataFrame:
    """Pairs (u, v) of different components that meet in ``posts`` and can be similar.

    A list's pairs are formed between its main component and the others and among the others, never within
    the main component.
    """
    share = threshold / (1 + threshold)
    counts = posts.groupBy("s", "component").agg(F.count("*").alias("times"))
    lists_ = counts.groupBy("s").agg(F.max(F.struct("times", "component")).alias("main"), F.count("*").alias("k")).filter("k > 1")
    placed = posts.join(lists_.select("s", F.col("main.component").alias("main")), "s").withColumn("other", F.col("component") != F.col("main"))
    x = placed.filter("indexed").select("s", F.col("node").alias("x"), F.col("n").alias("nx"), F.col("ahead").alias("ax"), F.col("component").alias("cx"), F.col("other").alias("ox"), F.col("bits").alias("bx"))
    y = placed.select("s", F.col("node").alias("y"), F.col("n").alias("ny"), F.col("ahead").alias("ay"), F.col("component").alias("cy"), F.col("other").alias("oy"), F.col("bits").alias("by"))
    able = (F.col("ny") >= F.col("nx")) & (F.least(F.col("nx") - F.col("ax"), F.col("ny") - F.col("ay")) >= share * (F.col("nx") + F.col("ny")) - 1e-6) & (F.col("cx") != F.col("cy"))
    apart = sum((F.bit_count(F.get("bx", F.lit(k)).bitwiseXOR(F.get("by", F.lit(k)))) for k in range(BITS // 64)), F.lit(0))
    able &= F.col("nx") + F.col("ny") - apart >= 2 * share * (F.col("nx") + F.col("ny")) - 1e-6
    meet = lambda a, b: a.join(b.withColumnRenamed("s", "t"), (F.col("s") == F.col("t")) & able).select("x", "y")
    pairs = meet(x, y.filter("oy")).union(meet(x.filter("ox"), y.filter("NOT oy")))
    return pairs.select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct()


def linked_classes(docs: DataFrame, threshold: float = THRESHOLD, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, key, words), and of each class words, class_id, class_size and keep (the kept row's doc_id and key)."""
    rows = materialize(signed(docs), "signed", 1000)
    grouped = rows.filter("words IS NOT NULL").groupBy("words").agg(
        F.min(F.struct("doc_id", "key")).alias("one"), F.min("doc_id").alias("least"), F.count("*").alias("times"), F.first("n").alias("n"), F.first("bands").alias("bands")
    )
    classes = materialize(grouped.withColumn("node", F.monotonically_increasing_id()), "classes")
    posted = classes.select("node", "n", F.explode("bands").alias("key"))
    buckets = posted.groupBy("key").agg(F.min(F.struct("node", "n")).alias("lead"), F.max("node").alias("most")).filter("lead.node < most")
    members = materialize(posted.join(buckets.select("key", "lead"), "key"), "members")

    wanted = members.select("node").distinct().join(classes.select("node", "one.key"), "node")
    texts = docs.select(row_key(docs).alias("key"), "text").join(wanted, "key").dropDuplicates(["key"])
    bags = materialize(bagged(texts), "bags", 1000)

    first = members.filter((F.col("lead.node") < F.col("node")) & alike("lead.n", "n", threshold)).groupBy(F.col("node").alias("v")).agg(F.min("lead.node").alias("u"))
    labels = materialize(connected_components(verified(first, bags, threshold)), "components")
    for nth in range(rounds):
        left = materialize(split_buckets(members, labels), "left")
        labels = extended_components(labels, verified(random_pairs(left, nth, threshold), bags, threshold))
    posts = materialize(prefix_posts(split_buckets(members, labels), bags, threshold), "posts")
    close = not_apart(materialize(prefix_pairs(posts, threshold), "pairs"), bags, threshold)
    labels = extended_components(labels, verified(close, bags, threshold))

    placed = materialize(classes.select("words", "node", "one", "least", "times").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node")), "placed")
    sizes = placed.groupBy("component").agg(F.min("least").alias("class_id"), F.sum("times").alias("class_size"), F.min("one").alias("keep"))
    return rows.select("doc_id", "key", "words"), placed.select("words", "component").join(sizes, "component").drop("component")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, key (of the row), class_id, class_size, kept for every row of ``docs``; one kept document per class."""
    rows, classes = linked_classes(docs, threshold)
    same = F.col("doc_id").eqNullSafe(F.col("keep.doc_id")) & (F.col("key") == F.col("keep.key"))
    return rows.join(classes, "words", "left").select(
        "doc_id", "key",
        F.when(F.col("class_size").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
        F.when(F.col("class_size").isNull(), True).otherwise(same).alias("kept"),
    )


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` with one document of each near-duplicate class: the least by (doc_id, key).

    Of rows that agree in all columns one stays.
    """
    kept = near_duplicates(docs, threshold).filter("kept").select(F.col("key").alias("__kept"))
    return docs.withColumn("__key", row_key(docs)).join(kept, F.col("__key") == F.col("__kept"), "left_semi").dropDuplicates(["__key"]).drop("__key")
