"""Exact deduplication by content-defined chunk recipes (built-in functions only).

A text is cut where its own content says so: a chunk ends at the first sentence or line end after
``MIN_CHUNK`` characters and at ``MAX_CHUNK`` at the latest, so an insertion moves the cuts near it only
(a stretch of more than ``MAX_CHUNK`` characters without such an end is cut by length, and cuts in it move).
A chunk's identifier is its SHA-256; the chunk store has one row per identifier and verifies it (equal
identifiers must agree in length and in a second, independent hash, or the query fails rather than answer
wrongly). A document is its recipe: the ordered list of its chunks' identifiers. Equal lists are equal
texts, so groups are formed on the lists and the texts themselves never leave the scan.

Rows: null text counts as empty; an empty text has one empty chunk, so all empty texts are equal. Rows
that repeat a doc_id are rows of their own; every row holding the largest doc_id of a group is kept. A
null doc_id is smaller than any other; a group in which all are null keeps all its rows (keep_id null).
Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswave.storage import materialize

MIN_CHUNK, MAX_CHUNK = 1024, 8192
#: The text between the least and the largest size up to a line or sentence end, or what is left.
CHUNK = r"(?s).{%d,%d}?[\n.!?]|.{1,%d}" % (MIN_CHUNK - 1, MAX_CHUNK - 1, MAX_CHUNK)


def chunks(text: Column) -> Column:
    """The content-defined chunks of a text in order; concatenated they are the text."""
    found = F.regexp_extract_all(text, F.lit(CHUNK), F.lit(0))
    return F.when(F.length(text) > 0, found).otherwise(F.array(F.lit("")))


def recipes(docs: DataFrame) -> DataFrame:
    """doc_id, text_sha256, recipe: array of (id, check, size) for each row of ``docs``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    entry = lambda c: F.struct(F.unhex(F.sha2(c, 256)).alias("id"), F.xxhash64(c).alias("check"), F.octet_length(c).alias("size"))
    return docs.select("doc_id", F.sha2(text, 256).alias("text_sha256"), F.transform(chunks(text), entry).alias("recipe"))


def chunk_store(recipe_rows: DataFrame) -> DataFrame:
    """One row per chunk: id, size, refs, and whether all its uses agree (``verified``)."""
    uses = recipe_rows.select(F.explode("recipe").alias("c")).select("c.*")
    return uses.groupBy("id").agg(
        F.min("size").alias("size"),
        F.count("*").alias("refs"),
        ((F.min("size") == F.max("size")) & (F.min("check") == F.max("check"))).alias("verified"),
    )


def exact_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 and n_chunks for every row of ``docs``."""
    rows = materialize(recipes(docs), "recipes")
    wrong = chunk_store(rows).agg(F.count_if(~F.col("verified")).alias("wrong"))
    listed = rows.select("doc_id", "text_sha256", F.transform("recipe", lambda c: c["id"]).alias("ids"))
    groups = listed.groupBy("ids").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    # one row on the right: the verification of the chunk store
    groups = groups.crossJoin(F.broadcast(wrong)).filter(F.coalesce(F.assert_true(F.col("wrong") == 0, F.lit("two chunks share an identifier")).cast("boolean"), F.lit(True))).drop("wrong")
    return listed.join(groups, "ids").select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
        F.size("ids").alias("n_chunks"),
    )
