"""The prefix trie of conversations: nodes by digest, and sums over subtrees by pointer jumping."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leadlattice.llm.common import WORD_PATTERN, materialize

#: Ids of one node that are joined to one text before they meet: what one task gathers of a node is a part of this many.
PIECE = 4096

_CHAINED = "conv_id long, depth long, node string, parent string, words long, ends boolean"


def digested_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, turn_digest, words) of every turn; pos counts from 1 by turn, null first.

    Null roles and texts are empty. Equal turn numbers are ordered by role, then by the digest, so that texts are
    read once and never shuffled. Rows without a conv_id belong to no conversation and are left out.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.where("conv_id IS NOT NULL").select(
        "conv_id", "turn", role.alias("role"),
        F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256).alias("turn_digest"),
        F.regexp_count(text, F.lit(WORD_PATTERN)).cast("long").alias("words"),
    )
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "turn_digest")
    return turns.select("conv_id", F.row_number().over(order).cast("long").alias("pos"), "turn_digest", "words")


def own(turns: DataFrame) -> DataFrame:
    """Conversations as they are: one row per turn, and one at pos 0 for each conversation's root."""
    roots = turns.select("conv_id").distinct().select("conv_id", F.lit(0).cast("long").alias("part"), F.lit(0).cast("long").alias("pos"), F.lit(None).cast("string").alias("turn_digest"), F.lit(0).cast("long").alias("words"))
    return roots.unionByName(turns.withColumn("part", F.lit(2).cast("long")))


def sharing_heads(turns: DataFrame, base: Column, head: Column, most: int) -> DataFrame:
    """As `own`, but each conversation's first `head` turns are those of conversation `base` (columns of conv_id), as many as it has.

    `head` is at most `most`. A conversation with fewer turns than that may be left with its root alone.
    """
    rows = own(turns)
    ids = rows.where("part = 0").select("conv_id", base.alias("base"), head.alias("head"))
    heads = turns.where(F.col("pos") <= most).withColumnRenamed("conv_id", "base")
    lent = ids.where("head > 0").join(heads, "base").where("pos <= head").select("conv_id", F.lit(1).cast("long").alias("part"), "pos", "turn_digest", "words")
    return rows.where((F.col("part") == 0) | (F.col("pos") > head)).unionByName(lent)


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs through sorted conversations with one digest of all that was read of the present one."""
    fields = ["conv_id", "depth", "node", "parent", "words", "ends"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_()]
    held: list | None = None  # the last row, until it is known whether its conversation goes on
    state = hashlib.sha256()
    for batch in batches:
        out: list[list] = []
        for conv, digest, words in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn_digest", "words")), strict=True):
            if held is not None and held[0] == conv:
                state.update(digest.encode("ascii"))
                row = [conv, held[1] + 1, state.hexdigest(), held[2], words, True]
                held[5] = False
            else:
                state = hashlib.sha256()
                row = [conv, 0, state.hexdigest(), None, 0, True]
            if held is not None:
                out.append(held)
            held = row
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], fields)
    if held is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(held, types, strict=True)], fields)


def prefixes(rows: DataFrame) -> DataFrame:
    """(conv_id, depth, node, parent, words, ends): every prefix of every conversation of (conv_id, part, pos, turn_digest, words).

    `node` is the SHA-256 of the digests of a prefix's turns, so equal prefixes have equal nodes. A conversation streams through its task in order; only a digest's state is held.
    """
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "part", "pos").mapInArrow(_chain, _CHAINED)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joins runs of at most PIECE sorted ids of one node by commas."""
    node, ids, out = None, [], []

    def flush() -> None:
        if ids:
            out.append((node, ids[0], ",".join(map(str, ids))))
            ids.clear()

    def batch_of() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.string()), strict=True)], ["node", "first", "piece"])
        out.clear()
        return made

    for batch in batches:
        for n, c in zip(batch.column("node").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
            if n != node or len(ids) == PIECE:
                flush()
                node = n
            ids.append(c)
        if out:
            yield batch_of()
    flush()
    if out:
        yield batch_of()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest per node over its sorted pieces."""
    node, state = None, hashlib.sha256()
    for batch in batches:
        nodes, digests = [], []
        for n, piece in zip(batch.column("node").to_pylist(), batch.column("piece").to_pylist(), strict=True):
            if n == node:
                state.update(b",")
            else:
                if node is not None:
                    nodes.append(node)
                    digests.append(state.hexdigest())
                node, state = n, hashlib.sha256()
            state.update(piece.encode("ascii"))
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.string()), pa.array(digests, pa.string())], ["node", "ends_sha256"])
    if node is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node]), pa.array([state.hexdigest()])], ["node", "ends_sha256"])


def end_digests(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256) of (node, conv_id): the digest of a node's ids, ascending, comma-joined.

    Ids are sorted by range over (node, id), so that many tasks share a node at which very many conversations end; they join their ids to pieces, and only pieces meet, as a stream.
    """
    pieces = ends.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(_pieces, "node string, first long, piece string")
    return pieces.repartition("node").sortWithinPartitions("node", "first").mapInArrow(_hashed, "node string, ends_sha256 string")


def rolled_up(nodes: DataFrame, deepest: int) -> DataFrame:
    """(node, leaves, saved) summed over subtrees of nodes (node, parent, depth, leaves, saved).

    After k rounds a node holds the sums over what lies less than 2^k below it, and a pointer to the node 2^k above: each round adds the
    sums of all that point to a node and lets each pointer jump over its target's, so a chain of any length takes its logarithm of rounds. Sums are combined before they
    are shuffled; many pointers to one node are a skewed join, which Spark splits. Each round is written.
    """
    state = nodes.select("node", "depth", F.col("parent").alias("up"), "leaves", "saved")
    reach = 1
    while reach <= deepest:
        targets = state.select(F.col("node").alias("up"), F.col("up").alias("next"))
        none = F.lit(None).cast("string")
        # Only what is deep enough has a next pointer, so a child of the root never looks for one.
        jumps = state.where(F.col("depth") >= 2 * reach).select("node", "up").join(targets, "up").select("node", F.lit(0).cast("long").alias("depth"), "next", F.lit(0).cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved"))
        given = state.where("up IS NOT NULL").select(F.col("up").alias("node"), F.lit(0).cast("long").alias("depth"), none.alias("next"), "leaves", "saved")
        kept = state.select("node", "depth", none.alias("next"), "leaves", "saved")
        merged = kept.unionByName(given).unionByName(jumps).groupBy("node").agg(F.max("depth").alias("depth"), F.max("next").alias("up"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        state, reach = materialize(merged, "round"), 2 * reach
    return state.select("node", "leaves", "saved")


def trie(rows: DataFrame) -> DataFrame:
    """The nodes of the trie of conversations given as rows of `own` or `sharing_heads`.

    Per node: conv_id (smallest member), depth, parent_conv_id (null at the root), n_convs, n_children, n_leaves, saved_tokens
    (words of the last text that all members but one needn't read again, over the subtree), ends_sha256 (members that end here) and node, its digest. No conversation, no node.
    """
    chained = materialize(prefixes(rows), "prefixes")
    one, none = F.lit(0).cast("long"), F.lit(None)
    nodes = chained.groupBy("node").agg(F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("parent").alias("parent"), F.first("words").alias("words"), F.count(F.lit(1)).alias("n_convs"))
    nodes = materialize(nodes, "nodes")
    # A child is a row at its parent, so children are counted without a join.
    child = nodes.where("parent IS NOT NULL").select(F.col("parent").alias("node"), none.cast("long").alias("conv_id"), none.cast("long").alias("depth"), none.cast("string").alias("parent"), one.alias("words"), one.alias("n_convs"), F.lit(1).cast("long").alias("n_children"))
    nodes = nodes.withColumn("n_children", one).unionByName(child).groupBy("node").agg(F.max("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.max("parent").alias("parent"), F.max("words").alias("words"), F.max("n_convs").alias("n_convs"), F.sum("n_children").alias("n_children"))
    nodes = materialize(nodes.withColumn("leaves", (F.col("n_children") == 0).cast("long")).withColumn("saved", (F.col("n_convs") - 1) * F.col("words")), "nodes")
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    sums = rolled_up(nodes, deepest)
    ends = materialize(end_digests(chained.where("ends").select("node", "conv_id")), "ends")
    parents = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return (
        nodes.drop("leaves", "saved").join(sums, "node").join(ends, "node", "left").join(parents, "parent", "left")
        .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"), "node")
    )


def shared_prefixes(conversations: DataFrame) -> DataFrame:
    """The trie of conversations c whose first crc32(decimal c) % 4 turns are those of conversation c - c % 20."""
    c = F.col("conv_id").cast("long")
    return trie(sharing_heads(digested_turns(conversations), c - c % 20, F.crc32(c.cast("string").cast("binary")) % 4, most=3))
