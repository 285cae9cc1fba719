"""Exact copies by compressed radix tries whose terminal nodes hold the owner of a text.

Tasks insert the full normalised bytes of their texts into a trie; what ends in
one node is one record (length, digest, text, ids), so copies are combined
before anything moves. Records are partitioned and sorted by length and content hash
and inserted into the tries of their partition, where a terminal node keeps the
owner and the number of rows. A trie with more than ``LIMIT`` bytes spills its heaviest
subtrees: on the first side as records, which meet again on the second; on the
second side, between two digests, as finished owners.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociq.llm.text import LOWER, buffer, slices
from lociq.session import cut_lineage, use_checkpoint_folder

#: Bytes of a trie, and of texts of a batch of records.
LIMIT, BATCH_BYTES = 24 << 20, 4 << 20
#: What a node and an id count for.
NODE_BYTES, ID_BYTES = 300, 64
#: Groups with more than this share of all rows are sent to every task: at most so many.
HEAVY = 1000


class Node:
    """A node: the bytes on the edge to it, its children by first byte, and what ends here."""

    __slots__ = ("label", "kids", "held")

    def __init__(self, label: bytes):
        self.label = label
        self.kids: dict[int, Node] = {}
        self.held: list | None = None


def common(label: bytes, text: bytes, at: int) -> int:
    """How many bytes ``label`` and ``text[at:]`` begin with in common; both begin with the same byte."""
    if text.startswith(label, at):
        return len(label)
    low, high, step = 1, min(len(label), len(text) - at), 1
    while low < high:
        mid = min(low + step, high)
        if text.startswith(label[low:mid], at + low):
            low, step = mid, 2 * step
        else:
            high, step = mid - 1, max(1, (mid - low) // 2)
    return low


class Trie:
    """A compressed radix trie of byte strings."""

    def __init__(self) -> None:
        self.root = Node(b"")
        self.bytes = 0

    def node(self, text: bytes) -> Node:
        """The node where ``text`` ends, made where it is missing."""
        node, at = self.root, 0
        while at < len(text):
            kid = node.kids.get(text[at])
            if kid is None:
                kid = node.kids[text[at]] = Node(text[at:])
                self.bytes += len(kid.label) + NODE_BYTES
                return kid
            same = common(kid.label, text, at)
            if same < len(kid.label):
                upper = node.kids[text[at]] = Node(kid.label[:same])
                kid.label = kid.label[same:]
                upper.kids[kid.label[0]] = kid
                self.bytes += NODE_BYTES
                kid = upper
            node, at = kid, at + same
        return node

    def spill(self, left: int) -> Iterator[tuple[bytes, list]]:
        """Take subtrees out, the heaviest first, until ``left`` bytes stay: their texts and what ends there."""
        if self.root.held is not None:
            yield b"", self.root.held
            self.root.held = None
        sizes = {first: sum(len(n.label) + NODE_BYTES + _ids(n) for n, _ in _below(kid)) for first, kid in self.root.kids.items()}
        self.bytes = sum(sizes.values())
        for first in sorted(sizes, key=sizes.__getitem__, reverse=True):
            if self.bytes <= left:
                break
            self.bytes -= sizes[first]
            for node, before in _below(self.root.kids.pop(first)):
                if node.held is not None:
                    yield before + node.label, node.held


def _below(top: Node) -> Iterator[tuple[Node, bytes]]:
    """The nodes of a subtree and the bytes before each; deep tries don't nest calls."""
    stack = [(top, b"")]
    while stack:
        node, before = stack.pop()
        yield node, before
        if node.kids:
            here = before + node.label
            stack += [(kid, here) for kid in node.kids.values()]


def _ids(node: Node) -> int:
    return 0 if node.held is None else ID_BYTES * len(node.held)


def _rank(row_id: int | None, largest: bool) -> tuple:
    """Owners have the highest rank; a null id has the lowest."""
    return (row_id is not None, (row_id if largest else -row_id) if row_id is not None else 0)


def combine(batches: Iterator[pa.RecordBatch], largest: bool, limit: int) -> Iterator[pa.RecordBatch]:
    """Records (record, length, digest, text, ids, owner, at, n): the rows of a task with one text, unless a spill parts them."""
    trie, count = Trie(), TaskContext.get().partitionId() << 33

    def records(spilled: Iterator[tuple[bytes, list]]) -> Iterator[pa.RecordBatch]:
        nonlocal count
        rows, held = [], 0
        for text, ids in spilled:
            best = max(range(len(ids)), key=lambda k: (*_rank(ids[k], largest), -k))
            rows.append({"record": count, "length": len(text), "digest": sha256(text).digest(), "text": text, "ids": ids, "owner": ids[best], "at": best, "n": len(ids)})
            count, held = count + 1, held + len(text) + 8 * len(ids)
            if held > BATCH_BYTES:
                yield pa.RecordBatch.from_pylist(rows, _RECORDS)
                rows, held = [], 0
        yield pa.RecordBatch.from_pylist(rows, _RECORDS)

    for batch in batches:
        for part in slices(batch, "text"):
            codes, bounds = buffer(part.column("text"))
            raw, ends = LOWER[codes].tobytes(), bounds.tolist()
            for row_id, a, b in zip(part.column("id").to_pylist(), ends[:-1], ends[1:], strict=True):
                node = trie.node(raw[a:b])
                if node.held is None:
                    node.held = []
                node.held.append(row_id)
                trie.bytes += ID_BYTES
            if trie.bytes > limit:
                yield from records(trie.spill(limit // 2))
    yield from records(trie.spill(-1))


_RECORDS = pa.schema([("record", pa.int64()), ("length", pa.int64()), ("digest", pa.binary()), ("text", pa.binary()), ("ids", pa.list_(pa.int64())), ("owner", pa.int64()), ("at", pa.int64()), ("n", pa.int64())])
_OWNERS = pa.schema([("length", pa.int64()), ("digest", pa.binary()), ("owner", pa.int64()), ("record", pa.int64()), ("at", pa.int64()), ("n", pa.int64())])


def owners(batches: Iterator[pa.RecordBatch], largest: bool, limit: int) -> Iterator[pa.RecordBatch]:
    """(length, digest, owner, record, at, n) of each text, from records sorted by length and digest."""
    trie, last, here = Trie(), None, None

    def finished(left: int) -> Iterator[pa.RecordBatch]:
        rows = [dict(zip(_OWNERS.names, held, strict=True)) for _, held in trie.spill(left)]
        yield pa.RecordBatch.from_pylist(rows, _OWNERS)

    for batch in batches:
        names = ("length", "digest", "owner", "record", "at", "n")
        for row in zip(batch.column("text"), *(batch.column(c).to_pylist() for c in names), strict=True):
            key = row[1:3]
            if key != last and trie.bytes > limit:  # all texts of the digests before are in
                yield from finished(limit // 2)
            node = trie.node(row[0].as_buffer().to_pybytes())
            if key == last and node is not here:
                raise ValueError(f"two texts have the SHA-256 {row[2].hex()}")
            last, here = key, node
            if node.held is None:
                node.held = list(row[1:])
                continue
            held = node.held
            if (*_rank(row[3], largest), -row[4]) > (*_rank(held[2], largest), -held[3]):
                held[2:5] = row[3:6]
            held[5] += row[6]
    yield from finished(-1)


def exact_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", keep: str = "largest") -> DataFrame:
    """(id, keep_id, group_size, kept, digest, length) per row: the row that stays of all with the same text.

    Texts are equal when their UTF-8 bytes are, after lower-casing A-Z; ``length`` and ``digest``
    (SHA-256) are of these. Null counts as empty. The row with the ``keep``
    (largest or smallest) id stays, a null id before none; of rows with one id, or of
    rows that all have none, exactly one is ``kept``. An empty table gives an
    empty result, and further columns are ignored.
    """
    spark, largest = docs.sparkSession, {"largest": True, "smallest": False}[keep]
    folder = f"{use_checkpoint_folder(spark).rstrip('/')}/copies-{uuid.uuid4()}"
    limit = LIMIT
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    made = rows.mapInArrow(lambda b: combine(b, largest, limit), "record long, length long, digest binary, text binary, ids array<long>, owner long, at long, n long")
    made.write.option("compression", "zstd").parquet(folder)
    records = spark.read.parquet(folder)
    key = ["length", "digest"]
    sorted_records = records.drop("ids").repartition(*key).sortWithinPartitions(*key)
    owned = sorted_records.mapInArrow(lambda b: owners(b, largest, limit), "length long, digest binary, owner long, record long, at long, n long")
    owned = cut_lineage(owned.select(*key, F.col("owner").alias("keep_id"), F.col("record").alias("keep_record"), F.col("at").alias("keep_at"), F.col("n").alias("group_size")))

    # A group with a great share of the rows would be one task of the join.
    total = owned.agg(F.sum("group_size")).first()[0] or 0
    heavy = F.broadcast(owned.where(F.col("group_size") * HEAVY > total))
    ids = records.select(*key, "record", "ids")
    found = ids.join(heavy, key).unionByName(ids.join(heavy.select(*key), key, "left_anti").join(owned.where(F.col("group_size") * HEAVY <= total), key))
    each = found.select("*", F.posexplode("ids").alias("_at", "id"))
    return each.select(
        F.col("id").alias(id_column), "keep_id", "group_size", ((F.col("record") == F.col("keep_record")) & (F.col("_at") == F.col("keep_at"))).alias("kept"), "digest", "length"
    )
