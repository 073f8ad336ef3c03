"""Quality classifier: document evidence combined with host and path posteriors by hierarchical empirical Bayes.

A logistic model over hashed character trigrams (shares of ``BUCKETS`` buckets) and five statistics of words
gives each document's evidence: its log-odds beyond the base rate. Texts are read once to score them, in
numpy over slices of Arrow batches. Hosts shrink to the global mean and paths to their host: Beta priors
whose strength comes from the spread between groups (method of moments). All of this is grouped sums with
partial aggregates; a document's own score is taken out of its site's before the two are combined. A site
seldom seen is close to the global prior; a document's own evidence always counts in full.

The model is fitted on about ``FIT_ROWS`` labelled documents at most, those with the least hash of doc_id;
its size does not depend on the corpus. Without labels of both classes every document has evidence 0 and is
kept.

Rows: null text counts as empty; null host or path is a group of its own. Rows that repeat a doc_id are
rows of their own; the model is fitted on one of them. Labels with a null doc_id or label are ignored; of
labels that repeat a doc_id the least counts. Extra columns are carried by ``keep_good``, whatever their
names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswave.functions.expressions import row_key
from presswave.llm.lookup import slices
from presswave.storage import materialize

FIT_ROWS, KEEP_AT = 4096, 0.5
STRENGTHS = (1.0, 1000.0)  # least and largest prior strength, in documents
BUCKETS, STATISTICS = 512, 5
#: Characters measured at once; counts add up over the parts of a longer text.
BLOCK = 1 << 19
PARTS = 1 << 40


def trigram_counts(texts: list[str]) -> np.ndarray:
    """How many trigrams of each text fall in each bucket."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    owner = np.repeat(np.arange(len(texts)), sizes)
    if len(codes) < 3:
        return np.zeros((len(texts), BUCKETS))
    h = codes[:-2] * np.uint32(0x9E3779B1) + codes[1:-1] * np.uint32(0x85EBCA77) + codes[2:] * np.uint32(0xC2B2AE3D)
    h ^= h >> np.uint32(15)
    bucket = (h * np.uint32(0x27D4EB2F)) >> np.uint32(23)
    own = owner[2:] == owner[:-2]
    return np.bincount(owner[:-2][own] * BUCKETS + bucket[own], minlength=len(texts) * BUCKETS).reshape(-1, BUCKETS).astype(float)


def features(texts: list[str]) -> np.ndarray:
    """Roots of the buckets' shares, and size, characters a word, share of different words, longest word, share of words that repeat the one before, of each text."""
    lowered = [x.lower() for x in texts]
    if max(map(len, lowered), default=0) <= BLOCK:
        counts = trigram_counts(lowered)
    else:
        # parts overlap by two characters, so no trigram is lost or counted twice
        counts = np.stack([sum(trigram_counts([x[k : k + BLOCK + 2]])[0] for k in range(0, max(1, len(x) - 2), BLOCK)) for x in lowered])
    out = np.empty((len(texts), BUCKETS + STATISTICS))
    out[:, :BUCKETS] = np.sqrt(counts / np.maximum(1, counts.sum(axis=1, keepdims=True)))
    for k, x in enumerate(lowered):
        words = x.split()
        n = max(1, len(words))
        out[k, BUCKETS:] = np.log1p(n) / 10, min(len(x) / n, 40) / 40, len(set(words)) / n, min(max(map(len, words), default=0), 100) / 100, sum(map(eq, words, words[1:])) / n
    return out


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 25, block: int = 512) -> tuple[np.ndarray, float]:
    """Weights (constant last) of a ridge logistic model by Newton steps, and the log-odds of the base rate.

    Sums go over blocks of rows, so the driver holds the sample once.
    """
    mean, scale = x.mean(0, dtype=float), x.std(0, dtype=float) + 1e-6
    size = x.shape[1] + 1
    w, base = np.zeros(size), float(np.log(y.mean() / (1 - y.mean())))
    w[-1] = base
    penalty = np.full(size, ridge * len(x))
    penalty[-1] = 0
    for _ in range(rounds):
        bend, slope = np.diag(penalty + 1e-6), -penalty * w
        for k in range(0, len(x), block):
            z = np.column_stack([(x[k : k + block] - mean) / scale, np.ones(len(x[k : k + block]))])
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            bend += (z * (p * (1 - p))[:, None]).T @ z
            slope += z.T @ (y[k : k + block] - p)
        step = np.linalg.solve(bend, slope)
        w += step
        if np.abs(step).max() < 1e-5:
            break
    return np.append(w[:-1] / scale, w[-1] - (w[:-1] * mean / scale).sum()), base


def labelled(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS) -> DataFrame:
    """text and quality (0 or 1) of about ``most`` labelled documents at most, those with the least hash of doc_id."""
    good = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    good = materialize(good, "labels")
    below = PARTS * most // max(most, good.count())
    some = good.filter(F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)) < below).select(F.col("doc_id").alias("__doc"), F.col("quality").alias("__quality"))
    # about ``most`` rows at most, each of an id and a number: a bounded broadcast
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(some), F.col("doc_id") == F.col("__doc"))
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("__quality").alias("quality")).select("text", (F.col("quality") > 0).cast("double").alias("quality"))


def fitted(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS) -> tuple[np.ndarray, float] | None:
    """The model, or None without labels of both classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", BLOCK):
            x = features(part.column(0).to_pylist()).astype(np.float32)
            flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([flat, part.column(1)], ["x", "quality"])

    sample = labelled(docs, labels, most).mapInArrow(run, "x array<float>, quality double").toArrow()
    y = sample["quality"].to_numpy()
    if len(y) == 0 or y.min() == y.max():
        return None
    x = sample["x"].combine_chunks().flatten().to_numpy().reshape(len(y), -1)
    order = np.lexsort(x.T[:8])  # the sums of the fit do not depend on the order of tasks
    return fit(x[order], y[order])


def evidence(docs: DataFrame, host: Column, path: Column, model: tuple[np.ndarray, float]) -> DataFrame:
    """doc_id, key, host, path, evidence and p of every row."""
    weights, base = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", BLOCK):
            score = features(part.column(4).to_pylist()) @ weights[:-1] + weights[-1]
            yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array(np.clip(score - base, -30, 30))], ["doc_id", "key", "host", "path", "evidence"])

    text = F.coalesce("text", F.lit("")).alias("text")
    site = lambda c, name: F.coalesce(c.cast("string"), F.lit("")).alias(name)
    rows = docs.select("doc_id", row_key(docs).alias("key"), site(host, "host"), site(path, "path"), text)
    scored = rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, key string, host string, path string, evidence double")
    return scored.withColumn("p", 1 / (1 + F.exp(-(F.col("evidence") + base))))


def strength(mean: Column, spread: Column) -> Column:
    """Of a Beta prior with this mean whose groups' means have this variance."""
    return F.greatest(F.lit(STRENGTHS[0]), F.least(F.lit(STRENGTHS[1]), F.coalesce(F.try_divide(mean * (1 - mean), spread) - 1, F.lit(STRENGTHS[1]))))


def posteriors(scored: DataFrame) -> DataFrame:
    """doc_id, key, evidence, host_mean, path_mean and posterior for rows with host, path, evidence, p.

    Between-group variances are those of group means less the share that sampling explains.
    """
    paths = materialize(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("q")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"), F.sum("q").alias("hq"))
    noise = lambda n, s, q: F.greatest(q / n - F.pow(s / n, F.lit(2)), F.lit(0.0)) / n
    one = hosts.agg(
        (F.sum("hs") / F.sum("hn")).alias("m0"),
        F.greatest(F.var_pop(F.col("hs") / F.col("hn")) - F.avg(noise(F.col("hn"), F.col("hs"), F.col("hq"))), F.lit(0.0)).alias("v0"),
    )
    two = paths.join(hosts, "host").agg(
        F.greatest(F.avg(F.pow(F.col("s") / F.col("n") - F.col("hs") / F.col("hn"), F.lit(2))) - F.avg(noise(F.col("n"), F.col("s"), F.col("q"))), F.lit(0.0)).alias("v1"),
    )
    g, v = one.first(), two.first()
    m0 = g["m0"] if g["m0"] is not None else 0.5
    k0 = strength(F.lit(m0), F.lit(g["v0"] or 0.0))
    k1 = strength(F.lit(m0), F.lit(v["v1"] or 0.0))
    sites = paths.join(hosts, "host").select("host", "path", "n", "s", "hn", "hs")
    own = F.col("p")
    host = (k0 * m0 + F.col("hs") - own) / (k0 + F.col("hn") - 1)
    path = (k1 * host + F.col("s") - own) / (k1 + F.col("n") - 1)
    safe = F.least(F.greatest(path, F.lit(0.01)), F.lit(0.99))
    return scored.join(sites, ["host", "path"]).select(
        "doc_id", "key", "evidence", host.alias("host_mean"), path.alias("path_mean"),
        (1 / (1 + F.exp(-(F.col("evidence") + F.log(safe / (1 - safe)))))).alias("posterior"),
    )


def classify(docs: DataFrame, labels: DataFrame, host: str = "source", path: Column | None = None, keep_at: float = KEEP_AT, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, key (of the row), evidence, host_mean, path_mean, posterior, kept for every row of ``docs``.

    ``path`` defaults to host/lang: the table of documents has no deeper path.
    """
    path = F.concat_ws("/", F.col(host), F.col("lang")) if path is None else path
    model = fitted(docs, labels, fit_rows)
    if model is None:
        return docs.select("doc_id", row_key(docs).alias("key"), *(F.lit(0.0).alias(c) for c in ("evidence", "host_mean", "path_mean")), F.lit(1.0).alias("posterior"), F.lit(True).alias("kept"))
    scored = materialize(evidence(docs, F.col(host), path, model), "evidence", 1000)
    return posteriors(scored).withColumn("kept", F.col("posterior") >= keep_at)


def keep_good(docs: DataFrame, labels: DataFrame, host: str = "source") -> DataFrame:
    """The rows of ``docs`` that the classifier keeps."""
    kept = classify(docs, labels, host).filter("kept").select(F.col("key").alias("__kept"))
    return docs.withColumn("__key", row_key(docs)).join(kept, F.col("__key") == F.col("__kept"), "left_semi").drop("__key")
