"""Prefix trie of conversations from vertical bitmaps.

A shard is some conversations. It indexes each (position, turn) to the bitset of
its conversations with that turn there and walks depth-first: the lowest conversation
left in a node's bitset names a posting, the intersection of the two is a child, and what
it covers is taken off, so there are as many intersections as nodes. Popcounts
are the members, the lowest bit is the smallest id, and bitsets by length are the ends.

A node is known in all shards by the hash of its path. Shards give it counts that add
up. What must count once however many shards have the node (its own text, whether it is
a leaf) is added by the shard that has its smallest member, so sums over
subtrees are made inside shards, too, and then add up.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lociq.session import cut_lineage

#: Turns of a shard, on average.
SHARD_TURNS = 20_000
#: Path of the root.
ROOT = bytes(16)

_NODES = pa.schema(
    [("shard", pa.int64()), ("at", pa.int64()), ("up", pa.int64()), ("depth", pa.int64()), ("path", pa.binary()), ("above", pa.binary())]
    + [("n", pa.int64()), ("low", pa.int64()), ("chars", pa.int64()), ("inner", pa.int64()), ("ends", pa.list_(pa.int64()))]
)
_NODES_SQL = "shard long, at long, up long, depth long, path binary, above binary, n long, low long, chars long, inner long, ends array<long>"
_SUMS = pa.schema([("path", pa.binary()), ("parent", pa.int64()), ("leaves", pa.int64()), ("saved", pa.int64())])


def turns_in_order(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, position from 1, key, chars) of each turn, in order of turn (null first) and then of key; no text moves.

    ``key`` is half of the SHA-256 of role and text, ``chars`` the code points of the text;
    null role or text is empty. Rows without a conversation id belong to none.
    """
    said, who = F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(role), F.lit(""))
    key = F.unhex(F.substring(F.sha2(F.concat(F.char_length(who).cast("string"), F.lit(":"), who, said), 256), 1, 32))
    rows = conversations.where(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), key.alias("key"), F.char_length(said).cast("long").alias("chars"))
    order = Window.partitionBy("conv").orderBy(F.asc_nulls_first("turn"), "key")
    return rows.select("conv", F.row_number().over(order).cast("long").alias("position"), "key", "chars")


def with_shared_heads(turns: DataFrame, group: int = 100, most: int = 6) -> DataFrame:
    """Conversations that begin with turns of another: (conv, position, key, chars), and a row with position 0 for each conversation.

    Conversation c gets the first h turns of conversation c - c % ``group`` (all if it has fewer,
    none if there is none), then its own turns after its first h; h = crc32(c) % ``most``.
    """
    turns = cut_lineage(turns)
    convs = turns.groupBy("conv").agg(F.max("position").alias("many"))
    convs = cut_lineage(convs.select("conv", "many", (F.col("conv") - F.col("conv") % group).alias("base"), (F.crc32(F.col("conv").cast("string")) % most).alias("h")))
    bases = convs.select(F.col("conv").alias("base"), F.col("many").alias("base_many"))
    convs = convs.join(bases, "base", "left").select("conv", "base", "h", F.least("h", F.coalesce("base_many", F.lit(0))).alias("taken"))
    # At most ``most`` turns of a base go to each of its at most ``group`` conversations.
    first = turns.where(F.col("position") < most).withColumnRenamed("conv", "base")
    heads = convs.join(first, "base").where("position <= h").select("conv", "position", "key", "chars")
    own = turns.join(convs, "conv").where("position > h").select("conv", (F.col("taken") + F.col("position") - F.col("h")).alias("position"), "key", "chars")
    marks = convs.select("conv", F.lit(0).cast("long").alias("position"), F.lit(None).cast("binary").alias("key"), F.lit(0).cast("long").alias("chars"))
    return marks.unionByName(heads).unionByName(own)


def shard_nodes(shard: int, table: pa.Table) -> pa.Table:
    """The trie of one shard, a row for each node in depth-first order."""
    table = table.sort_by([("conv", "ascending"), ("position", "ascending")])
    conv, position = (table.column(c).to_numpy() for c in ("conv", "position"))
    ids, first = np.unique(conv, return_index=True)
    length = np.diff(np.append(first, len(conv))) - 1  # one row of each is its mark
    keys, chars, first, ids = table.column("key").to_pylist(), table.column("chars").to_pylist(), first.tolist(), ids.tolist()
    number: dict[tuple[int, bytes], int] = {}
    postings: list[int] = []
    posted = []  # posting of each row
    owner = np.repeat(np.arange(len(ids)), length + 1).tolist()
    for row, (i, d) in enumerate(zip(owner, position.tolist(), strict=True)):
        if d == 0:
            posted.append(-1)
            continue
        p = number.setdefault((d, keys[row]), len(postings))
        if p == len(postings):
            postings.append(0)
        postings[p] |= 1 << i
        posted.append(p)
    done: dict[int, int] = {}
    for i, n in enumerate(length.tolist()):
        done[n] = done.get(n, 0) | 1 << i

    out: list[tuple] = []
    stack = [(-1, 0, (1 << len(ids)) - 1, ROOT, None, 0)]
    while stack:
        up, depth, members, path, above, n_chars = stack.pop()
        at = len(out)
        low = (members & -members).bit_length() - 1
        ended = members & done.get(depth, 0)
        rest = members ^ ended
        out.append((shard, at, up, depth, path, above, members.bit_count(), ids[low], n_chars, int(rest != 0), [ids[i] for i in _bits(ended)]))
        while rest:
            row = first[(rest & -rest).bit_length() - 1] + depth + 1
            kid = rest & postings[posted[row]]
            rest ^= kid
            stack.append((at, depth + 1, kid, blake2b(path + keys[row], digest_size=16).digest(), path, chars[row]))
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _NODES, strict=True)], schema=_NODES)


def _bits(x: int) -> Iterator[int]:
    """Places of the bits set, lowest first."""
    while x:
        yield (x & -x).bit_length() - 1
        x &= x - 1


def subtree_sums(table: pa.Table) -> pa.Table:
    """What a shard adds to the sums of each of its nodes: leaves, and code points saved.

    Saved are (members - 1) times the text of each node below: the members of all shards, less the text once.
    """
    table = table.sort_by("at")
    up = table.column("up").to_pylist()
    mine = table.column("low").to_numpy() == table.column("node_low").to_numpy()
    leaves = (mine & (table.column("node_inner").to_numpy() == 0)).astype(np.int64).tolist()
    saved = (table.column("chars").to_numpy() * (table.column("n").to_numpy() - mine)).tolist()
    for at in range(len(up) - 1, 0, -1):  # children come after their parents
        leaves[up[at]] += leaves[at]
        saved[up[at]] += saved[at]
    low = table.column("node_low").to_pylist()
    parent = [None if u < 0 else low[u] for u in up]
    return pa.Table.from_arrays([table.column("path").combine_chunks(), pa.array(parent, pa.int64()), pa.array(leaves, pa.int64()), pa.array(saved, pa.int64())], schema=_SUMS)


def digests_of_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, ends_sha256) from rows (path, conv) sorted by both: a list is digested as it streams by."""
    path, digest = None, sha256()
    for batch in batches:
        out = []
        paths, convs = batch.column("path").to_pylist(), batch.column("conv").to_pylist()
        edges = [0, *(k for k in range(1, len(paths)) if paths[k] != paths[k - 1]), len(paths)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if a == b:
                continue
            text = ",".join(map(str, convs[a:b])).encode()
            if paths[a] == path:
                digest.update(b"," + text)
                continue
            if path is not None:
                out.append((path, digest.hexdigest()))
            path, digest = paths[a], sha256(text)
        yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.string())], names=["path", "ends_sha256"])
    if path is not None:
        yield pa.RecordBatch.from_arrays([pa.array([path], pa.binary()), pa.array([digest.hexdigest()], pa.string())], names=["path", "ends_sha256"])


def prefix_nodes(turns: DataFrame) -> DataFrame:
    """A row for each node: path, conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``turns`` has (conv, position, key, chars) with positions 1, 2, ... and a row with position 0
    for each conversation, so that those without turns are members of the root. A node is a distinct sequence of
    first keys. ``saved_tokens`` counts ``chars``; sums over a subtree include its top. Without conversations
    there are no nodes. Turns are told apart, and paths known, by 128-bit hashes.
    A conversation is in one shard as a whole: memory of a task grows with its longest conversation,
    and the ends of one node are digested in one task, as a stream.
    """
    # A million turns in 20,000 more shards would be no harm, so a rough count does.
    shards = max(1, math.ceil(turns.count() / SHARD_TURNS))
    dealt = turns.withColumn("shard", F.pmod(F.xxhash64("conv"), F.lit(shards).cast("long")))
    nodes = cut_lineage(dealt.groupBy("shard").applyInArrow(lambda key, table: shard_nodes(key[0].as_py(), table), _NODES_SQL))
    one = nodes.groupBy("path").agg(F.max("depth").alias("depth"), F.max("above").alias("above"), F.sum("n").alias("n_convs"), F.min("low").alias("node_low"), F.max("inner").alias("node_inner"))
    one = cut_lineage(one)
    judged = nodes.select("shard", "at", "up", "path", "n", "low", "chars").join(one.select("path", "node_low", "node_inner"), "path")
    sums = judged.groupBy("shard").applyInArrow(subtree_sums, "path binary, parent long, leaves long, saved long")
    sums = sums.groupBy("path").agg(F.max("parent").alias("parent_conv_id"), F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    children = one.where(F.col("above").isNotNull()).groupBy(F.col("above").alias("path")).agg(F.count("*").alias("n_children"))
    ends = nodes.select("path", F.explode("ends").alias("conv")).repartition("path").sortWithinPartitions("path", "conv").mapInArrow(digests_of_ends, "path binary, ends_sha256 string")
    return (
        one.join(sums, "path")
        .join(children, "path", "left")
        .join(ends, "path", "left")
        .select(
            "path", F.col("node_low").alias("conv_id"), "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"), "n_leaves", "saved_tokens",
            F.coalesce("ends_sha256", F.lit(sha256().hexdigest())).alias("ends_sha256"),
        )
    )
