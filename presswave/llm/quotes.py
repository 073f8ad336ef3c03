"""Chat formatting by quotation linking (built-in functions only).

A line's quote level is the number of '>' marks it starts with. Passages are quoted lines and quoted runs
(neighbouring lines of one level); a message's own passages are its unquoted lines and paragraphs. A
passage is normalised (marks off, white space folded, lower case) and hashed. The original of a passage in
a conversation is the earliest message that has it unquoted: one grouped minimum, so a passage however
common is one row to join. A message answers the original of its outermost quoted passage that has one
(runs before lines, then the one quoted first); without one it answers the turn before. Quotes and the
attribution lines above them ("... wrote:") are taken out of the text.

Conversations are ordered by (reply_to, turn): a message comes after the one it answers, and answers to one
message stand together. ``place`` counts the conversation's turns in that order from 1. The turn before and
the place are found in blocks of ``BLOCK`` turn numbers, so a conversation with a third of all rows is many
groups. All work on a text is linear in its lines.

Rows: null text counts as empty. Rows with a null conv_id or turn answer nothing and have no place. Rows that
repeat a (conv_id, turn) are formatted each and share a place; their passages belong to that one turn. Extra columns are ignored. An
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from presswave.functions.expressions import let
from presswave.storage import materialize

BLOCK = 256
MARKS = r"^(?:\s*>)+"
ATTRIBUTION = r"(?i)\bwrote:\s*$"


def normalised(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def passage_hash(text: Column) -> Column:
    return F.substring(F.unhex(F.sha2(normalised(text), 256)), 1, 16)


def parsed(text: Column) -> Column:
    """(lines, starts): each line's (level, body), and where runs start: neighbouring lines of one level; blank unquoted lines part paragraphs."""
    rows = F.transform(
        F.split(F.coalesce(text, F.lit("")), "\n", -1),
        lambda x: F.struct(F.length(F.regexp_replace(F.regexp_extract(x, MARKS, 0), r"[^>]", "")).alias("level"), F.regexp_replace(x, MARKS, "").alias("body")),
    )
    kinds = lambda r: F.transform(r, lambda x: F.when((x["level"] == 0) & (F.trim(x["body"]) == ""), F.lit(-1)).otherwise(x["level"]))
    first = lambda k: F.filter(F.sequence(F.lit(0), F.size(k) - 1), lambda i: (i == 0) | (F.get(k, i) != F.get(k, i - 1)))
    return let(rows, lambda r: F.struct(r.alias("lines"), let(kinds(r), first).alias("starts")))


def passages(messages: DataFrame) -> DataFrame:
    """conv_id, turn, level, pos, whole (a run, else a line), hash of every passage with words of (conv_id, turn, p)."""
    lines = F.transform("p.lines", lambda x, i: F.struct(x["level"].alias("level"), i.alias("pos"), F.lit(0).alias("whole"), x["body"].alias("body")))
    runs = F.transform(
        "p.starts",
        lambda s, i: F.struct(
            F.get(F.col("p.lines"), s)["level"].alias("level"), F.lit(-1).alias("pos"), F.lit(1).alias("whole"),
            F.array_join(F.transform(F.slice("p.lines", s + 1, F.coalesce(F.get(F.col("p.starts"), i + 1), F.size("p.lines")) - s), lambda x: x["body"]), " ").alias("body"),
        ),
    )
    rows = messages.select("conv_id", "turn", F.explode(F.concat(lines, runs)).alias("q"))
    return rows.filter(F.trim("q.body") != "").select("conv_id", "turn", "q.level", "q.pos", "q.whole", passage_hash(F.col("q.body")).alias("hash"))


def turns_before(messages: DataFrame) -> DataFrame:
    """conv_id, turn, before: the next smaller turn of the conversation."""
    block = F.floor(F.col("turn") / BLOCK)
    turns = messages.select("conv_id", "turn").filter("conv_id IS NOT NULL AND turn IS NOT NULL").distinct().withColumn("block", block)
    last = turns.groupBy("conv_id", "block").agg(F.max("turn").alias("last"))
    ahead = last.withColumn("ahead", F.lag("last").over(Window.partitionBy("conv_id").orderBy("block"))).select("conv_id", "block", "ahead")
    inside = F.lag("turn").over(Window.partitionBy("conv_id", "block").orderBy("turn"))
    return turns.withColumn("inside", inside).join(ahead, ["conv_id", "block"]).select("conv_id", "turn", F.coalesce("inside", "ahead").alias("before"))


def unquoted(lines: Column) -> Column:
    """The unquoted lines, without attribution lines that stand above a quote."""
    own = lambda s: F.filter(F.transform(s, lambda x, i: F.when((x["level"] == 0) & ~(x["body"].rlike(ATTRIBUTION) & (F.coalesce(F.get(s, i + 1)["level"], F.lit(0)) > 0)), x["body"])), lambda x: x.isNotNull())
    return F.trim(F.array_join(let(lines, own), "\n"))


def placed(replies: DataFrame) -> DataFrame:
    """``replies`` (conv_id, turn, reply_to; one row a turn) with ``place``: from 1, by (reply_to, turn).

    Counts are added up from blocks of answered turns, then answered turns, then blocks of answering turns, and
    rows are numbered only within such a block.
    """
    answered = F.coalesce("reply_to", F.lit(-(1 << 62)))  # answering nothing comes first
    rows = replies.withColumns({"answered": answered, "high": F.floor(answered / BLOCK), "low": F.floor(F.col("turn") / BLOCK)})
    keys, ahead = ["conv_id", "high", "answered", "low"], F.lit(0)
    counts = rows.groupBy(*keys).count()
    for depth in (1, 2, 3):
        level = counts.groupBy(*keys[: depth + 1]).agg(F.sum("count").alias("n"))
        before = Window.partitionBy(*keys[:depth]).orderBy(keys[depth]).rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.join(level.select(*keys[: depth + 1], F.coalesce(F.sum("n").over(before), F.lit(0)).alias(f"ahead{depth}")), keys[: depth + 1])
        ahead = ahead + F.col(f"ahead{depth}")
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy("turn"))
    return rows.withColumn("inside", inside).join(counts.select(*keys, ahead.alias("ahead")), keys).select("conv_id", "turn", "reply_to", (F.col("ahead") + F.col("inside")).alias("place"))


def link_quotes(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, reply_to, place, quoted, linked, text for every message.

    ``quoted`` counts quoted lines with words, ``linked`` those found in an earlier message.
    """
    messages = conversations.select("conv_id", "turn", "role", parsed(F.col("text")).alias("p"))
    found = materialize(passages(messages.filter("conv_id IS NOT NULL AND turn IS NOT NULL")), "passages")
    quotes = found.filter("level > 0").distinct()
    # the message that has a passage first
    originals = found.filter("level = 0").groupBy("conv_id", "hash").agg(F.min("turn").alias("origin"))
    linked = quotes.join(originals, ["conv_id", "hash"], "left").withColumn("origin", F.when(F.col("origin") < F.col("turn"), F.col("origin")))
    rank = F.struct("level", -F.col("whole"), "pos", "origin")
    parents = linked.groupBy("conv_id", "turn").agg(
        F.min(F.when(F.col("origin").isNotNull(), rank)).getField("origin").alias("parent"),
        F.count_if(F.col("whole") == 0).alias("quoted"),
        F.count_if((F.col("whole") == 0) & F.col("origin").isNotNull()).alias("linked"),
    )
    known = materialize(turns_before(conversations).join(parents, ["conv_id", "turn"], "left").withColumn("reply_to", F.coalesce("parent", "before")), "replies")
    places = placed(known.select("conv_id", "turn", "reply_to")).select("conv_id", "turn", "place")
    answers = known.select("conv_id", "turn", "reply_to", "quoted", "linked").join(places, ["conv_id", "turn"])
    texts = messages.select("conv_id", "turn", "role", unquoted(F.col("p.lines")).alias("text"))
    return texts.join(answers, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", "role", "reply_to", "place",
        F.coalesce("quoted", F.lit(0)).cast("long").alias("quoted"), F.coalesce("linked", F.lit(0)).cast("long").alias("linked"), "text",
    )


def conversations_in_order(conversations: DataFrame) -> DataFrame:
    """The messages of ``link_quotes`` sorted within tasks by conversation in reply order; a long conversation is several ranges."""
    return link_quotes(conversations).repartitionByRange("conv_id", "place").sortWithinPartitions("conv_id", "place")
