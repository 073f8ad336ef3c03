"""Prefix trie of conversations by chained cryptographic digests of their turns.

Turns leave their texts at once: a turn is the SHA-256 of its role and text, and its text's bytes. One streamed
pass over the sorted turns of each conversation chains them, so the digest at depth d names the first d turns.
Every prefix is a row; grouped by (depth, digest) they are the nodes, with partial sums, so a first turn that a
third of all conversations share costs a row for each task.

Sums over subtrees: a node's name is its smallest member. The nodes with one name are a path from some depth
down to that conversation's end, because deeper nodes have fewer members. Each path, not each node, is exploded
to all its ancestors (the names its conversation meets above, with the depth where it leaves each), so a
long conversation that others leave at few places costs few rows; then a running sum up each path adds what joins it.
To find the names of its prefixes a conversation meets the nodes by digest: those with at least
max(``HOT``, rows / ``MOST_HOT``) members are at most ``MOST_HOT`` rows and are broadcast, the others meet in a shuffle
where no key has more rows than that.

The digest of the conversations that end at a node is over one list by its definition: ids are joined in blocks of
neighbouring ids and the blocks of a node are hashed in their order as they stream by, in constant memory.

Rows: null role and text count as empty; rows with a null conv_id take no part. Turns are ordered by turn (null
first), ties by role and digest; repeated rows are turns of their own. Extra columns are ignored. An
empty table gives an empty result, not a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from presswave.storage import materialize

#: Nodes with more members than max(HOT, rows / MOST_HOT) are broadcast: at most MOST_HOT of them.
HOT, MOST_HOT = 4096, 8192
#: Neighbouring ids joined into one text before they are hashed.
BLOCK_BITS = 14
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), digest and bytes of every turn, without its text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    slim = conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "digest")
    return slim.select("conv_id", F.row_number().over(order).cast("long").alias("pos"), "digest", "bytes")


def grafted(turns: DataFrame, heads: int = 9, family: int = 5) -> tuple[DataFrame, DataFrame]:
    """Turns and conversations where conversation c begins with the first h turns of c - c % ``family`` and goes on after its own first h.

    h is CRC-32 of c modulo ``heads``. The first has the columns of ``turns`` with ``size``, the turns of the
    conversation; the second has conv_id and size of every conversation, also of those left without a turn.
    """
    first = turns.filter((F.col("conv_id") % family == 0) & (F.col("pos") < heads))
    first = first.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("pos", "digest", "bytes"))).alias("head"))  # fewer than ``heads`` turns
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("own"))
    convs = convs.select("*", (F.crc32(F.col("conv_id").cast("string")) % heads).alias("h"), (F.col("conv_id") - F.col("conv_id") % family).alias("base"))
    none = F.array().cast("array<struct<pos:bigint,digest:binary,bytes:bigint>>")
    met = convs.join(first.withColumnRenamed("conv_id", "base"), "base", "left").select("conv_id", "h", "own", F.slice(F.coalesce("head", none), F.lit(1), F.col("h").cast("int")).alias("head"))
    size = F.size("head") + F.greatest(F.col("own") - F.col("h"), F.lit(0))
    met = materialize(met.select("conv_id", "h", "head", size.cast("long").alias("size")), "heads")
    new = met.select("conv_id", "size", F.explode("head").alias("t")).select("conv_id", "t.pos", "t.digest", "t.bytes", "size")
    bounds = met.select("conv_id", "h", F.size("head").alias("taken"), "size")
    kept = turns.join(bounds, "conv_id").filter(F.col("pos") > F.col("h"))
    return new.unionByName(kept.select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "digest", "bytes", "size")), met.select("conv_id", "size")


def chained(turns: DataFrame) -> DataFrame:
    """conv_id, depth, node, parent (digests), bytes and ``ends`` for every prefix but the empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state, sha = None, b"", hashlib.sha256
        for batch in batches:
            nodes, parents = [], []
            for conv, digest in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if conv != last:
                    last, state = conv, b""
                parents.append(state)
                state = sha(state + digest).digest()
                nodes.append(state)
            ends = pc.equal(batch.column(1), batch.column(4))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(nodes, pa.binary()), pa.array(parents, pa.binary()), batch.column(3), ends], ["conv_id", "depth", "node", "parent", "bytes", "ends"])

    ordered = turns.select("conv_id", "pos", "digest", "bytes", "size").repartition("conv_id").sortWithinPartitions("conv_id", "pos")
    return ordered.mapInArrow(run, "conv_id long, depth long, node binary, parent binary, bytes long, ends boolean")


def list_digests(ends: DataFrame) -> DataFrame:
    """node and ends_sha256: SHA-256 of the conv_ids at each node, ascending and joined by commas."""
    block = F.shiftright("conv_id", BLOCK_BITS).alias("block")
    joined = ends.groupBy("node", block).agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("node", pa.binary()), ("ends_sha256", pa.string())])
        last = sha = None
        for batch in batches:
            done = []
            for node, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if node != last:
                    if sha:
                        done.append({"node": last, "ends_sha256": sha.hexdigest()})
                    last, sha = node, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            yield pa.RecordBatch.from_pylist(done, schema)
        if sha:
            yield pa.RecordBatch.from_pylist([{"node": last, "ends_sha256": sha.hexdigest()}], schema)

    return joined.repartition("node").sortWithinPartitions("node", "block").select("node", "ids").mapInArrow(run, "node binary, ends_sha256 string")


def named(prefixes: DataFrame, nodes: DataFrame, rows: int) -> DataFrame:
    """conv_id, depth and ``name`` (the node's smallest member) of every prefix of the conversations that name a node."""
    hot = F.col("n_convs") >= max(HOT, rows // MOST_HOT)
    owners = nodes.select(F.col("conv_id").alias("owner")).distinct()
    own = prefixes.select("conv_id", "depth", "node").join(owners, F.col("conv_id") == F.col("owner"), "left_semi")
    few = nodes.filter(hot).select(F.col("node").alias("hot_node"), F.col("conv_id").alias("hot_name"))
    marked = own.join(F.broadcast(few), F.col("node") == F.col("hot_node"), "left")  # at most MOST_HOT rows
    rest = marked.filter("hot_name IS NULL").select("conv_id", "depth", "node").join(nodes.filter(~hot).select("node", F.col("conv_id").alias("name")), "node")
    return rest.select("conv_id", "depth", "name").union(marked.filter("hot_name IS NOT NULL").select("conv_id", "depth", F.col("hot_name").alias("name")))


def prefix_trie(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """The nodes of the trie over ``turns`` (conv_id, pos, digest, bytes, size) and ``conversations`` (conv_id, size).

    conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    prefixes = materialize(chained(turns), "prefixes")
    grouped = prefixes.groupBy("depth", "node").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("parent").alias("parent"), F.min("bytes").alias("bytes"))
    nodes = materialize(grouped, "nodes")
    whole = conversations.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")).first()
    rows = prefixes.count()
    children = nodes.filter("depth > 1").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    saved = (F.col("n_convs") - 1) * F.col("bytes")
    family = nodes.join(children, "node", "left").select("depth", "node", "conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), saved.alias("saved"))
    family = materialize(family.withColumn("leaf", (F.col("n_children") == 0).cast("long")), "families")
    # where each path leaves each path above it, and what it brings to them
    above = named(prefixes, nodes, rows).filter("name <> conv_id").groupBy("conv_id", "name").agg(F.max("depth").alias("at"))
    above = materialize(above, "ancestors")
    own = family.groupBy("conv_id").agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))
    joins = above.join(own, "conv_id").groupBy(F.col("name").alias("conv_id"), F.col("at").alias("depth")).agg(F.sum("leaf").alias("more_leaf"), F.sum("saved").alias("more_saved"))
    parents = above.groupBy("conv_id").agg(F.max_by("name", "at").alias("top_parent"))
    up = Window.partitionBy("conv_id").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, 0)
    below = Window.partitionBy("conv_id").orderBy("depth")
    total = lambda c: F.sum(F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).over(up)
    parent = F.when(F.col("depth") == 1, F.lit(whole["conv_id"])).otherwise(F.coalesce(F.lag("conv_id").over(below), F.col("top_parent")))
    ends = list_digests(prefixes.filter("ends").select("node", "conv_id"))
    summed = family.join(joins, ["conv_id", "depth"], "left").join(parents, "conv_id", "left").select("node", "conv_id", "depth", parent.alias("parent_conv_id"), "n_convs", "n_children", total("leaf").alias("n_leaves"), total("saved").alias("saved_tokens"))
    digest = F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)).alias("ends_sha256")
    below_root = summed.join(ends, "node", "left").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", digest)
    return below_root.union(_root(conversations, family, whole).select(*below_root.columns))


def _root(conversations: DataFrame, family: DataFrame, whole: Row) -> DataFrame:
    """The row of the root, or none without conversations."""
    sums = family.agg(F.count_if(F.col("depth") == 1).alias("children"), F.sum("leaf").alias("leaves"), F.coalesce(F.sum("saved"), F.lit(0)).alias("saved")).first()
    ends = list_digests(conversations.filter("size = 0").select(F.lit(b"").alias("node"), "conv_id")).first()  # one node, one row
    row = (whole["conv_id"], 0, None, whole["n_convs"], sums["children"], sums["leaves"] or 1, sums["saved"], ends["ends_sha256"] if ends else EMPTY_SHA256)
    names = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
    return family.sparkSession.createDataFrame([row] if whole["n_convs"] else [], names)
