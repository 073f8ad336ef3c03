"""Line deduplication across documents (built-in functions only).

The decision moves only hashes of lines; the text is shuffled once, to meet the runs of lines it keeps. Each row's long line keys are hashed; their first uses in a row are
pre-aggregated by (hash, salt) on the map side, so a line found in a third of all rows is a few partial
rows. Those are range-partitioned by hash with a secondary sort by document (largest first) and position,
and one pass over each sorted run streams its first occurrence: the keeper of the key. The verdicts go back
to the lines by hash, and each document gets a compressed bitmap: the runs (start, length) of lines it keeps.

Rows: null text counts as empty and has one empty line. Every row is a document; rows that repeat a
doc_id count as several documents, and all rows of the largest doc_id keep their lines. A null doc_id is
smaller than any other. Keys shorter than ``min_chars`` are never dropped. ``dedup_lines`` carries extra
columns with their values; columns named n_lines or n_dropped are replaced. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from presswave.functions.expressions import let

SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_CHARS, MIN_DOCS, SALTS = 20, 3, 64


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACE)), UPPER, LOWER)


def row_tag() -> Column:
    """Tells apart rows that repeat a doc_id with another text."""
    return F.xxhash64("doc_id", "text")


def hashed_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, tag, hash, pos and ``first`` (its first use in this row) of every long line."""
    keyed = F.transform(lines(F.col("text")), lambda x, i: F.struct(line_key(x).alias("key"), i.alias("pos")))
    long = F.filter(keyed, lambda x: F.length(x["key"]) >= min_chars)
    hashed = F.transform(long, lambda x: F.struct(F.substring(F.unhex(F.sha2(x["key"], 256)), 1, 16).alias("hash"), x["pos"].alias("pos")))
    flagged = let(
        F.sort_array(hashed),
        lambda s: F.transform(s, lambda x, i: F.struct(x["hash"].alias("hash"), x["pos"].alias("pos"), ((i == 0) | (F.get(s, i - 1)["hash"] != x["hash"])).alias("first"))),
    )
    rows = docs.select("doc_id", row_tag().alias("tag"), F.explode(flagged).alias("f"))
    return rows.select("doc_id", "tag", "f.hash", "f.pos", "f.first")


def keepers(found: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """hash, keep_doc of every key in at least ``min_docs`` documents."""
    partial = (
        found.filter("first")
        .groupBy("hash", F.pmod(F.col("tag"), F.lit(SALTS)).alias("salt"))
        .agg(F.max(F.struct("doc_id", (-F.col("pos")).alias("back"))).alias("top"), F.count("*").alias("docs"))
    )
    run = Window.partitionBy("hash")
    ranged = partial.select("hash", "top", "docs").repartitionByRange("hash").sortWithinPartitions("hash", F.col("top").desc())
    streamed = ranged.select(
        "hash",
        F.col("top.doc_id").alias("keep_doc"),
        F.row_number().over(run.orderBy(F.col("top").desc())).alias("nth"),
        F.sum("docs").over(run).alias("all_docs"),
    )
    return streamed.filter((F.col("nth") == 1) & (F.col("all_docs") >= min_docs)).select("hash", "keep_doc")


def keep_runs(dropped: Column, n_lines: Column) -> Column:
    """The runs of kept lines between the sorted positions of dropped ones."""
    bounds = F.concat(F.array(F.lit(-1)), dropped, F.array(n_lines))
    runs = lambda b: F.transform(F.sequence(F.lit(1), F.size(b) - 1), lambda i: F.struct((F.get(b, i - 1) + 1).alias("start"), (F.get(b, i) - F.get(b, i - 1) - 1).alias("length")))
    return F.filter(let(bounds, runs), lambda r: r["length"] > 0)


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, tag and the sorted positions of dropped lines, for the rows that lose any."""
    found = hashed_lines(docs, min_chars)
    lost = found.join(keepers(found, min_docs), "hash").filter(~F.col("doc_id").eqNullSafe(F.col("keep_doc")))
    return lost.groupBy("doc_id", "tag").agg(F.sort_array(F.collect_set("pos")).alias("dropped"))


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, tag, n_lines, n_dropped, keep: array of (start, length), for every row of ``docs``; no text."""
    sizes = docs.select("doc_id", row_tag().alias("__tag"), F.size(lines(F.col("text"))).alias("__n"))
    kept = _with_runs(sizes, dropped_lines(docs, min_chars, min_docs))
    return kept.select("doc_id", F.col("__tag").alias("tag"), F.col("__n").cast("long").alias("n_lines"), F.col("__lost").alias("n_dropped"), F.col("__keep").alias("keep"))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """The rows of ``docs`` with ``text`` reduced to its kept lines, and n_lines and n_dropped added."""
    rows = docs.withColumns({"__tag": row_tag(), "__n": F.size(lines(F.col("text")))})
    kept = _with_runs(rows, dropped_lines(docs, min_chars, min_docs))
    some = let(lines(F.col("text")), lambda x: F.array_join(F.flatten(F.transform("__keep", lambda r: F.slice(x, r["start"] + 1, r["length"]))), "\n"))
    text = F.when(F.col("__lost") == 0, F.coalesce("text", F.lit(""))).otherwise(some).alias("text")
    carried = [text if c == "text" else F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    return kept.select(*carried, F.col("__n").cast("long").alias("n_lines"), F.col("__lost").alias("n_dropped"))


def _with_runs(rows: DataFrame, lost: DataFrame) -> DataFrame:
    """``rows`` (doc_id, __tag, __n ...) with __lost (lines) and __keep (runs)."""
    lost = lost.select(F.col("doc_id").alias("__lost_doc"), F.col("tag").alias("__lost_tag"), F.col("dropped").alias("__dropped"))
    joined = rows.join(lost, (F.col("__tag") == F.col("__lost_tag")) & F.col("doc_id").eqNullSafe(F.col("__lost_doc")), "left")
    none = F.coalesce("__dropped", F.array().cast("array<int>"))
    return joined.withColumns({"__lost": F.size(none).cast("long"), "__keep": keep_runs(none, F.col("__n"))}).drop("__lost_doc", "__lost_tag", "__dropped")
