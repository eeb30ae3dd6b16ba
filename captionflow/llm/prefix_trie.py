"""Conversation prefix trie by van Emde Boas recursion.

A conversation is a sequence of turns, a turn a symbol. Sequences of height H are cut at
half depth: the upper halves make an upper trie, the lower halves a forest with a tree
for each cut prefix, so a prefix has to be named before the trees below it can be told
apart. Upper trie and forests are then cut again, all of them in the same step, until
the height is one. The steps are as many as the logarithm of the longest conversation.

1. Names of blocks, upwards: a turn is named by the SHA-256 of its role and text; two
   neighbouring blocks of a size make one of twice the size, named by the SHA-256 of the
   two names (turns 1 to 2, 3 to 4 ...; 1 to 4, 5 to 8 ...).
2. Names of cut prefixes, downwards: at height H every prefix whose depth is a multiple of
   H has a name; the prefix half a height deeper is named by that name and the name of
   the block between. At height one all prefixes have names. Equal names are equal
   prefixes; a node is a (depth, name).
3. Nodes: the smallest member and the number of members, by one aggregation.
4. Totals, grafted upwards: at height H a cut node (its depth is an odd multiple of H/2)
   knows the total of its own tree of height H/2, from the steps before; it is added to
   each of the H/2 nodes above it in the upper trie. A node takes part once, with the
   lowest bit of its depth many nodes above it, so all steps together add a few rows for
   each node.

Keys are (conversation, block) or (depth, name): no step needs the turns of one
conversation, or the members of one node, in one task. Counts and smallest members are
combined before they are shuffled; the look-ups of names by the conversations that share
them are sort-merge joins of which Spark splits the hot keys. Texts are read once,
hashed and never shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, drop_stage, stage

#: Ids are joined to strings of about this length before a node's are hashed in order.
CHUNK = 1 << 16
ROOT_NAME = hashlib.sha256(b"").digest()
#: Conversations of this many ids share a head, of fewer turns than the second number.
FAMILY, HEADS = 100, 6


def _digest(*parts: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*parts), 256))


# ---------------------------------------------------------------- turns
def numbered_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns in order, and where each stretch of them stands.

    First: (conv_id, part, nth, name, chars), sorted by (conv_id, turn, name), nulls
    first; ``nth`` counts up within a task. Second: (conv_id, part, first, base): the
    turns of a conversation that a task holds start at ``first`` and follow ``base``
    others. So ``nth - first + base + 1`` is a turn's place, and a conversation of any
    length is spread over tasks.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        _digest(F.octet_length(role).cast("string"), F.lit(":"), role, text).alias("name"),
        F.char_length(text).cast("long").alias("chars")).withColumn("row", F.monotonically_increasing_id())
    order = ["conv_id", "turn", "name", "row"]
    turns = stage(rows.repartitionByRange(*order).sortWithinPartitions(*order)
                  .select("conv_id", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("nth"),
                          "name", "chars"), "turns")
    per = turns.groupBy("conv_id", "part").agg(F.min("nth").alias("first"), F.count(F.lit(1)).alias("n"))
    ahead = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return turns, stage(per.withColumn("base", F.coalesce(F.sum("n").over(ahead), F.lit(0).cast("long"))), "stretches")


def plain_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations as they are: (conv_id, n_turns) and (conv_id, pos, name, chars)."""
    turns, per = numbered_turns(conversations)
    convs = per.groupBy("conv_id").agg(F.sum("n").alias("n_turns"))
    placed = turns.join(per, ["conv_id", "part"]).withColumn("pos", F.col("nth") - F.col("first") + F.col("base") + 1)
    return stage(convs, "conversations"), stage(placed.select("conv_id", "pos", "name", "chars"), "placed")


def shared_head_turns(conversations: DataFrame, family: int = FAMILY, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """Conversations that share heads: conversation c becomes the first h turns of
    conversation ``c - c % family`` (all if it has fewer, none if it is absent), then its
    own turns after its first h; h is crc32 of the decimal c, modulo ``heads``.

    Same columns as :func:`plain_turns`. A head is copied to the ids of its family only,
    as names."""
    turns, per = numbered_turns(conversations)
    own = per.groupBy("conv_id").agg(F.sum("n").alias("n_own")) \
        .withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads) \
        .withColumn("lead", F.col("conv_id") - F.col("conv_id") % family)
    lead = per.groupBy("conv_id").agg(F.sum("n").alias("n_lead")).withColumnRenamed("conv_id", "lead")
    convs = stage(own.join(lead, "lead", "left")
                  .withColumn("head", F.least("h", F.coalesce("n_lead", F.lit(0).cast("long"))))
                  .withColumn("n_turns", F.col("head") + F.greatest(F.lit(0).cast("long"), F.col("n_own") - F.col("h"))),
                  "conversations")
    # head and h ride on the stretches, so that the turns are joined once, by (conv_id, part)
    info = per.join(convs.select("conv_id", "h", "head"), "conv_id")
    placed = turns.join(info, ["conv_id", "part"]).withColumn("at", F.col("nth") - F.col("first") + F.col("base") + 1)
    kept = placed.where("at > h").select("conv_id", (F.col("head") + F.col("at") - F.col("h")).alias("pos"), "name", "chars")
    first = placed.where((F.col("conv_id") % family == 0) & (F.col("at") < heads)) \
        .select(F.col("conv_id").alias("lead"), F.col("at").alias("pos"), "name", "chars")
    copied = first.join(convs.select("conv_id", "lead", "head"), "lead").where("pos <= head") \
        .select("conv_id", "pos", "name", "chars")
    out = stage(kept.union(copied), "placed")
    drop_stage(turns, per)
    return convs.select("conv_id", "n_turns"), out


# ---------------------------------------------------------------- names
def prefix_names(convs: DataFrame, turns: DataFrame) -> tuple[DataFrame, int]:
    """(conv_id, depth, name, n_turns) for each prefix of each conversation, the empty one
    included, and the number of cuts: 2**cuts is over the longest conversation."""
    longest = convs.agg(F.max("n_turns")).first()[0] or 0
    cuts = max(1, int(longest).bit_length())
    blocks = [turns.select("conv_id", (F.col("pos") - 1).alias("j"), "name")]
    for _ in range(1, cuts):
        half = blocks[-1].groupBy("conv_id", F.shiftright("j", 1).alias("j")).agg(
            F.max(F.when(F.col("j") % 2 == 0, F.col("name"))).alias("left"),
            F.max(F.when(F.col("j") % 2 == 1, F.col("name"))).alias("right")).where("right is not null")
        blocks.append(stage(half.select("conv_id", "j", _digest("left", "right").alias("name")), "blocks"))
    named = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(bytearray(ROOT_NAME)).alias("name"), "n_turns")
    for k in reversed(range(cuts)):
        upper = blocks[k].where("j % 2 = 0").select("conv_id", (F.col("j") * (1 << k)).alias("depth"), F.col("name").alias("block"))
        cut = named.join(upper, ["conv_id", "depth"]).select(
            "conv_id", (F.col("depth") + (1 << k)).alias("depth"), _digest("name", "block").alias("name"), "n_turns")
        now = stage(named.union(cut), "prefixes")
        drop_stage(named)
        named = now
    drop_stage(*blocks[1:])
    return named, cuts


# ---------------------------------------------------------------- ends
def ends_digests(ends: DataFrame) -> DataFrame:
    """(depth, name, ends_sha256) from (depth, name, conv_id): the SHA-256 of each node's
    ids in decimal, ascending, comma-joined. The ids are sorted over all tasks and joined
    to strings of bounded length there; a node's strings pass one hash in order."""
    fields = "depth long, name binary, first long, ids string"

    def join(batches: Iterator[pa.RecordBatch]):
        out, key, first, ids, size = [], None, None, [], 0
        for b in batches:
            for depth, name, conv in zip(*(c.to_pylist() for c in b.columns)):
                if (depth, name) != key or size >= CHUNK:
                    if ids:
                        out.append((*key, first, ",".join(ids)))
                    key, first, ids, size = (depth, name), conv, [], 0
                ids.append(str(conv))
                size += len(ids[-1]) + 1
                if len(out) >= 5_000:
                    yield _rows(out)
                    out = []
        if ids:
            out.append((*key, first, ",".join(ids)))
        if out:
            yield _rows(out)

    def _rows(out):
        kinds = (pa.int64(), pa.binary(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["depth", "name", "first", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]):
        def rows(out):
            kinds = (pa.int64(), pa.binary(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)],
                                              ["depth", "name", "ends_sha256"])
        key, now, out = None, None, []
        for b in batches:
            for depth, name, ids in zip(*(c.to_pylist() for c in b.columns)):
                if (depth, name) == key:
                    now.update(b"," + ids.encode())
                    continue
                if key is not None:
                    out.append((*key, now.hexdigest()))
                key, now = (depth, name), hashlib.sha256(ids.encode())
            if len(out) >= 5_000:
                yield rows(out)
                out = []
        if key is not None:
            out.append((*key, now.hexdigest()))
        if out:
            yield rows(out)

    order = ["depth", "name", "conv_id"]
    joined = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(join, fields)
    return (joined.repartition("depth", "name").sortWithinPartitions("depth", "name", "first")
            .select("depth", "name", "ids").mapInArrow(digest, "depth long, name binary, ends_sha256 string"))


# ---------------------------------------------------------------- the trie
def trie_nodes(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """The nodes of the trie of conversations (conv_id, n_turns) with turns (conv_id, pos,
    name, chars): conv_id (the smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens and ends_sha256.

    A node is a distinct sequence of first turns, from the empty one; without any
    conversation there is none. ``n_leaves`` and ``saved_tokens`` (members but one, times
    the code points of the node's last text) are sums over the node's subtree.
    """
    bound_batches(convs.sparkSession)
    named, cuts = prefix_names(convs, turns)
    nodes = stage(named.groupBy("depth", "name").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")),
                  "nodes")
    root = nodes.where("depth = 0").select("conv_id").first()
    lowest = F.lit(root["conv_id"] if root else None).cast("long")
    # A conversation that is the smallest member at some depth is so at every depth below:
    # up to there its path is looked up, from there on it is its own. The others (whole
    # copies) own no node and need no path.
    owners = nodes.groupBy("conv_id").agg(F.min("depth").alias("own"))
    paths = named.select("conv_id", "depth", "name").join(owners, "conv_id")
    shared = paths.where("depth > 0 and depth < own").join(
        nodes.select("depth", "name", F.col("conv_id").alias("node")), ["depth", "name"]).select("conv_id", "depth", "node")
    path = stage(shared.union(paths.where("depth >= own").select("conv_id", "depth", F.col("conv_id").alias("node")))
                 .union(paths.where("depth = 0 and own > 0").select("conv_id", "depth", lowest.alias("node"))), "paths")

    # for each node the nodes above it, as many as the lowest bit of its depth
    bit = F.col("depth").bitwiseAND(-F.col("depth"))
    climb = nodes.where("depth > 0").select("conv_id", "depth", bit.alias("reach")).withColumn(
        "up", F.explode(F.sequence(F.col("depth") - F.col("reach"), F.col("depth") - 1)))
    above = stage(climb.join(path.withColumnRenamed("depth", "up"), ["conv_id", "up"]), "above")
    parent = above.where("up = depth - 1").select("conv_id", "depth", F.col("node").alias("parent_conv_id"))
    children = parent.groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")) \
        .agg(F.count(F.lit(1)).alias("n_children"))
    last = turns.select("conv_id", F.col("pos").alias("depth"), "chars")
    known = stage(nodes.join(children, ["conv_id", "depth"], "left").join(last, ["conv_id", "depth"], "left")
                  .join(parent, ["conv_id", "depth"], "left").select(
                      "conv_id", "depth", "name", "parent_conv_id", "n_convs",
                      F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"),
                      ((F.col("n_convs") - 1) * F.coalesce("chars", F.lit(0).cast("long"))).alias("saved")), "known")

    totals = known.select("conv_id", "depth", (F.col("n_children") == 0).cast("long").alias("n_leaves"),
                          F.col("saved").alias("saved_tokens"))
    for k in range(cuts):
        grafted = above.where(F.col("reach") == 1 << k).join(totals, ["conv_id", "depth"]).select(
            F.col("node").alias("conv_id"), F.col("up").alias("depth"), "n_leaves", "saved_tokens")
        now = stage(totals.union(grafted).groupBy("conv_id", "depth").agg(
            F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens")), "totals")
        drop_stage(totals)
        totals = now

    ends = ends_digests(named.where("depth = n_turns"))
    return known.join(totals, ["conv_id", "depth"]).join(ends, ["depth", "name"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame, shared_heads: bool = False) -> DataFrame:
    """:func:`trie_nodes` of ``conversations`` (conv_id, turn, role, text), as they are or
    with shared heads (:func:`shared_head_turns`).

    Turns are ordered by ``turn``, null first, and where it repeats by the SHA-256 of role
    and text; null roles and texts count as empty; rows without a conv_id belong to no
    conversation; repeated rows are turns like others; an empty table gives no rows;
    columns besides these four are not read. Conversations and texts of any length are
    taken whole.
    """
    return trie_nodes(*(shared_head_turns if shared_heads else plain_turns)(conversations))
