"""Prefix trie of conversations by whole-sequence collapse.

Conversations that say the same are collapsed to one weighted sequence, with the list of those that end there.
Sequences that are proper prefixes of others are dropped by an anti-join; what stays are the leaves.
Every figure of a node is then an aggregate over the prefixes of weighted sequences, so nothing walks the
trie level by level and the number of jobs does not depend on its depth.

A prefix is identified by its length and the sums, over its turns, of four 32-bit words of a digest of (place, role, text),
128 bits in all: running sums can be formed in blocks of BLOCK_TURNS, so a conversation with any number of turns is
split over tasks. What a node adds to the sums over its subtree is booked with one of the leaves below
it, its owner. A leaf's booked values are summed from its end upwards, and a node's subtree holds the sums of all
leaves below it from its depth on: work grows with the turns, not with their square.

No group of rows with a common key goes to one task whole: rows of a conversation are dealt out by ranges and
blocks, copies collapse in partial aggregates, children find their parent through ``with_parent``. Only the
digest of a list of ends is ordered by nature; it is formed by reading strings of up to IDS_AT_ONCE
ids, in order, one at a time.

Defined results: a null role or text is empty; null turns come first; rows with equal turns are ordered by their
digest; repeated rows are turns of their own; rows without conv_id belong to no conversation and are left out; an
empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skygauge.session import stage

GROUP = 100
MOST_BORROWED = 6
BLOCK_TURNS = 1024
IDS_AT_ONCE = 65_536
# Parents with more than a 1/PARENTS of all nodes as children are sent to all tasks: fewer than so many.
PARENTS = 4096
_ROW_BITS = 33

WORDS = ["w0", "w1", "w2", "w3"]
NODE = ["k1", "k2"]


def _ordered_turns(turns: DataFrame) -> DataFrame:
    """Staged (conv_id, pos, n, digest, chars): pos counts from 1 in the order of turns, n is the last pos.

    Rows are sorted by ranges; a conversation over several ranges gets its positions from the rows
    that each range has of it.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    said = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = turns.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").alias("turn"),
        said.alias("digest"),
        F.length(text).cast("long").alias("chars"),
        F.monotonically_increasing_id().alias("given"),
    )
    order = ["conv_id", F.asc_nulls_first("turn"), "digest", "given"]
    placed = stage(
        rows.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("conv_id", "digest", "chars", F.monotonically_increasing_id().alias("at")),
        "turns",
    )
    part = F.shiftrightunsigned("at", _ROW_BITS).alias("part")
    segments = placed.groupBy("conv_id", part).agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    # One row for each range that a conversation is in.
    conversation = Window.partitionBy("conv_id")
    earlier = conversation.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    segments = segments.withColumn("before", F.sum("rows").over(earlier) - F.col("rows")).withColumn(
        "n", F.sum("rows").over(conversation)
    )
    return stage(
        placed.withColumn("part", part)
        .join(segments, ["conv_id", "part"])
        .select("conv_id", (F.col("at") - F.col("first") + F.col("before") + 1).alias("pos"), "n", "digest", "chars"),
        "positions",
    )


def _by_block(conversations: DataFrame, length: str) -> DataFrame:
    """A row for each block of BLOCK_TURNS turns, to join rows of long conversations block by block."""
    last = F.floor((F.col(length) - 1) / BLOCK_TURNS)
    return conversations.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(last, F.lit(0)))))


def _block(pos: str) -> Column:
    return F.floor((F.col(pos) - 1) / BLOCK_TURNS)


def rebuild(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rebuilt turns (conv_id, depth, digest, chars) and conversations (conv_id, length).

    Conversation c has the first h turns of conversation c - c % GROUP, as far as these are there, and its own
    turns after its first h, where h is crc32 of c in decimal, modulo MOST_BORROWED.
    """
    placed = _ordered_turns(turns)
    own = placed.groupBy("conv_id").agg(F.count("*").alias("n"))
    conversations = own.select(
        "conv_id", "n", (F.col("conv_id") - F.col("conv_id") % GROUP).alias("root"),
        (F.crc32(F.col("conv_id").cast("string")) % MOST_BORROWED).alias("h"),
    )
    roots = own.filter(F.col("conv_id") % GROUP == 0).select(F.col("conv_id").alias("root"), F.col("n").alias("there"))
    borrowed = F.least("h", F.coalesce("there", F.lit(0)))
    conversations = stage(
        conversations.join(roots, "root", "left").select(
            "conv_id", "root", "n", "h", borrowed.alias("k"),
            (borrowed + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"),
        ),
        "conversations",
    )
    blocks = _by_block(conversations.select("conv_id", "n", "h", "k"), "n").drop("n")
    kept = (
        placed.withColumn("block", _block("pos"))
        .join(blocks, ["conv_id", "block"])
        .filter("pos > h")
        .select("conv_id", (F.col("pos") - F.col("h") + F.col("k")).alias("depth"), "digest", "chars")
    )
    # At most GROUP conversations meet at most MOST_BORROWED - 1 turns under a root.
    heads = placed.filter((F.col("conv_id") % GROUP == 0) & (F.col("pos") < MOST_BORROWED)).select(
        F.col("conv_id").alias("root"), F.col("pos").alias("depth"), "digest", "chars"
    )
    lent = (
        conversations.filter("k > 0")
        .select("conv_id", "root", "k")
        .join(heads, "root")
        .filter("depth <= k")
        .select("conv_id", "depth", "digest", "chars")
    )
    return kept.unionByName(lent), conversations.select("conv_id", "length")


def _node(depth: Column, sums: list[Column]) -> list[Column]:
    """The two longs that stand for a prefix."""
    return [F.xxhash64(F.lit(seed), depth.cast("long"), *sums).alias(k) for seed, k in enumerate(NODE)]


def _root_node() -> list[Column]:
    return _node(F.lit(0), [F.lit(0).cast("long")] * len(WORDS))


def prefixes(rebuilt: DataFrame) -> DataFrame:
    """Staged (conv_id, depth, block, chars, k1, k2, p1, p2): node and parent of each turn."""
    hashed = F.sha2(F.concat(F.col("depth").cast("string"), F.lit(":"), "digest"), 256)
    word = lambda k: F.conv(F.substring("hashed", 8 * k + 1, 8), 16, 10).cast("long")
    rows = rebuilt.withColumn("hashed", hashed).select(
        "conv_id", "depth", _block("depth").alias("block"), "chars", *[word(k).alias(w) for k, w in enumerate(WORDS)]
    )
    rows = stage(rows, "words")
    totals = rows.groupBy("conv_id", "block").agg(*[F.sum(w).alias(w) for w in WORDS])
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        "conv_id", "block", *[F.coalesce(F.sum(w).over(before), F.lit(0)).alias(f"before_{w}") for w in WORDS]
    )
    so_far = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    running = rows.select("*", *[F.sum(w).over(so_far).alias(f"in_{w}") for w in WORDS]).join(carried, ["conv_id", "block"])
    sums = [F.col(f"in_{w}") + F.col(f"before_{w}") for w in WORDS]
    above = [s - F.col(w) for s, w in zip(sums, WORDS, strict=True)]
    parent = [c.alias(p) for c, p in zip(_node(F.col("depth") - 1, above), ("p1", "p2"), strict=True)]
    return stage(running.select("conv_id", "depth", "block", "chars", *_node(F.col("depth"), sums), *parent), "prefixes")


def _hashed_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of the comma-joined ids of each node; their parts stand together, in order."""
    last, digest = None, None

    def made(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[*NODE, "ends_sha256"]
        )

    for batch in batches:
        rows = []
        for k1, k2, ids in zip(*(batch.column(c).to_pylist() for c in (*NODE, "ids")), strict=True):
            if (k1, k2) != last:
                if digest:
                    rows.append((*last, digest.hexdigest()))
                last, digest = (k1, k2), hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(ids.encode())
        if rows:
            yield made(rows)
    if digest:
        yield made([(*last, digest.hexdigest())])


def _end_lists(ends: DataFrame) -> DataFrame:
    """(k1, k2, ends_sha256) of the conversations that end in each node."""
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    parts = ends.groupBy(*NODE, F.floor(F.col("conv_id") / IDS_AT_ONCE).alias("range")).agg(ids.alias("ids"))
    ordered = parts.repartition(*NODE).sortWithinPartitions(*NODE, "range").select(*NODE, "ids")
    return ordered.mapInArrow(_hashed_lists, "k1 long, k2 long, ends_sha256 string")


def _with_parent(nodes: DataFrame, children: DataFrame) -> DataFrame:
    """``nodes`` with parent_conv_id; a parent of very many children is sent to all tasks."""
    count = nodes.count()
    many = F.col("n_children") > F.lit(count / PARENTS)
    parents = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id")).join(
        children, ["p1", "p2"]
    )
    parents = stage(parents, "parents")
    large = parents.filter(many).select("p1", "p2", F.col("parent_conv_id").alias("large"))
    rest = parents.filter(~many).select("p1", "p2", "parent_conv_id")
    found = nodes.join(F.broadcast(large), ["p1", "p2"], "left")
    # A child whose parent is known needs no other row.
    open_ = F.col("large").isNull() & (F.col("depth") > 0)
    done = found.filter(~open_).withColumnRenamed("large", "parent_conv_id")
    return done.unionByName(found.filter(open_).drop("large").join(rest, ["p1", "p2"]).select(*done.columns))


def prefix_trie(turns: DataFrame) -> DataFrame:
    """One row per node of the trie over the rebuilt conversations.

    Columns, all long but the last: conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256.
    """
    rebuilt, conversations = rebuild(turns)
    return trie_of(prefixes(rebuilt), conversations)


def trie_of(keyed: DataFrame, conversations: DataFrame) -> DataFrame:
    """The nodes over the prefixes (``prefixes``) of conversations (conv_id, length)."""
    # Each conversation as its last prefix; without turns, as the root.
    blocks = conversations.filter("length > 0").select(
        "conv_id", F.col("length").alias("depth"), F.floor((F.col("length") - 1) / BLOCK_TURNS).alias("block")
    )
    ends = keyed.join(blocks, ["conv_id", "block", "depth"], "left_semi").select("conv_id", "depth", *NODE)
    empty = conversations.filter("length = 0").select("conv_id", F.col("length").alias("depth"), *_root_node())
    ends = stage(ends.unionByName(empty), "ends")
    # Whole-sequence collapse: one weighted sequence for all conversations that say the same.
    sequences = stage(
        ends.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("weight"), F.max("depth").alias("length")),
        "sequences",
    )
    weighted = _by_block(sequences.select("conv_id", "weight", "length"), "length")
    paths = keyed.join(weighted, ["conv_id", "block"]).select(
        "conv_id", "weight", "length", "depth", "block", "chars", *NODE, "p1", "p2"
    )
    top = sequences.select(
        "conv_id", "weight", "length", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("block"),
        F.lit(0).cast("long").alias("chars"), *_root_node(),
        F.lit(None).cast("long").alias("p1"), F.lit(None).cast("long").alias("p2"),
    )
    paths = stage(paths.unionByName(top), "paths")
    proper = paths.filter("depth < length").select(*NODE).distinct()
    leaves = stage(sequences.join(proper, NODE, "left_anti").select("conv_id", "length"), "leaves")
    leaf_blocks = _by_block(leaves, "length").drop("length")
    leaf_paths = stage(
        paths.join(leaf_blocks, ["conv_id", "block"], "left_semi").select("conv_id", "depth", "block", *NODE), "leaf paths"
    )
    below = leaf_paths.groupBy(*NODE).agg(F.count("*").alias("n_leaves"), F.min("conv_id").alias("owner"))
    nodes = paths.groupBy(*NODE).agg(
        F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.sum("weight").alias("n_convs"),
        F.max("chars").alias("chars"), F.max("p1").alias("p1"), F.max("p2").alias("p2"),
    )
    nodes = stage(nodes.join(below, NODE), "nodes")
    # Values are booked with the owner and summed from the end of its path upwards.
    booked = nodes.select(
        F.col("owner").alias("conv_id"), "depth", ((F.col("n_convs") - 1) * F.col("chars")).alias("value")
    ).filter("value > 0")
    valued = leaf_paths.join(booked, ["conv_id", "depth"], "left").withColumn("value", F.coalesce("value", F.lit(0)))
    valued = stage(valued, "booked")
    totals = valued.groupBy("conv_id", "block").agg(F.sum("value").alias("total"))
    after = Window.partitionBy("conv_id").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select("conv_id", "block", F.coalesce(F.sum("total").over(after), F.lit(0)).alias("after"))
    from_end = Window.partitionBy("conv_id", "block").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    saved = (
        valued.withColumn("inside", F.sum("value").over(from_end))
        .join(carried, ["conv_id", "block"])
        .groupBy(*NODE)
        .agg(F.sum(F.col("inside") + F.col("after")).alias("saved_tokens"))
    )
    children = stage(nodes.filter("depth > 0").groupBy("p1", "p2").agg(F.count("*").alias("n_children")), "children")
    own = children.select(F.col("p1").alias("k1"), F.col("p2").alias("k2"), "n_children")
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    joined = reduce(lambda a, b: a.join(b, NODE, "left"), [own, saved, _end_lists(ends)], _with_parent(nodes, children))
    return joined.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"),
        "n_leaves", F.coalesce("saved_tokens", F.lit(0)).alias("saved_tokens"),
        F.coalesce("ends_sha256", nothing).alias("ends_sha256"),
    )
