"""Packing of documents into token sequences by the sum-of-squares rule.

Each piece goes where the sum, over all gaps, of the squared number of open bins
with that gap becomes smallest; a new bin is one of the choices. Pieces are dealt
to blocks of bounded size and each block is packed by one task. Pieces of the bins that stay open
(a few hundred of a block, whatever its size) are dealt out again and packed
anew until one block holds them all, so the waste is that of one block.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociq.llm.text import release, slices, unused
from lociq.llm.tokens import encoder
from lociq.session import cut_lineage

CAPACITY = 2048
#: Bytes of text that are encoded at a time: the tables of a word are many, and the words' ids stay known.
ENCODED = 250_000
#: Pieces of a block, on average.
BLOCK = 30_000
#: The shortest pieces of a block come last and fill what the others leave.
LAST = 0.2


def sum_of_squares(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each piece, in the order given, and the gap of each bin at the end. Ties go to the smallest gap, then the newest bin."""
    open_bins, holders, fill = np.zeros(capacity + 1, np.int64), defaultdict(list), []
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for n, size in enumerate(lengths.tolist()):
        gap = capacity
        if size < capacity:
            gaps = np.flatnonzero(open_bins[size:capacity]) + size
            if len(gaps):
                change = 2 * (open_bins[gaps - size] - open_bins[gaps]) + 2
                if gaps[0] == size:
                    change[0] = 1 - 2 * open_bins[size]  # a full bin is no longer counted
                best = int(change.argmin())
                if change[best] <= 2 * open_bins[capacity - size] + 1:
                    gap = int(gaps[best])
        if gap == capacity:
            fill.append(0)
            holder = len(fill) - 1
        else:
            holder = holders[gap].pop()
            open_bins[gap] -= 1
        bins[n], offsets[n] = holder, fill[holder]
        fill[holder] += size
        if size < gap:
            holders[gap - size].append(holder)
            open_bins[gap - size] += 1
    return bins, offsets, capacity - np.array(fill, np.int64)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, closing: int = 0, id_column: str = "doc_id", text_column: str = "text", words: bool = True, with_ids: bool = True) -> DataFrame:
    """(id, piece, start, length, ids_crc32, ids) of each row: its token ids and the closing one, cut only where longer than ``capacity``.

    A null or empty text has the closing id only. ``ids`` are little-endian
    unsigned 32-bit; without ``with_ids`` the column is null and only the checksum is made.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        column = encoder(tokenizer, words).column
        for batch in batches:
            for part in slices(batch, "text", ENCODED):
                ids, first = column(part.column("text"))
                ids = np.insert(ids, first[1:], closing).astype("<u4", copy=False)
                first = first + np.arange(len(first))
                n = np.diff(first)
                many = -(-n // capacity)
                row = np.repeat(np.arange(part.num_rows), many)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                start = piece * capacity
                length = np.minimum(n[row] - start, capacity)
                raw, at = ids.tobytes(), 4 * (first[row] + start)
                cut = [raw[a : a + 4 * k] for a, k in zip(at.tolist(), length.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id").take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array([zlib.crc32(c) for c in cut], pa.int64()), pa.array(cut if with_ids else [None] * len(cut), pa.binary())],
                    names=["id", "piece", "start", "length", "ids_crc32", "ids"],
                )
            release()

    kind = docs.schema[id_column].dataType.simpleString()
    made = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long, ids binary")
    return made.withColumnRenamed("id", id_column)


def pack(rows: DataFrame, capacity: int = CAPACITY, length_column: str = "length") -> DataFrame:
    """``rows`` with ``sequence_id`` and ``offset``: every row placed whole, without gaps from offset 0.

    Lengths must be between 1 and the capacity. Other columns, nulls and repeated
    rows come through as they are; columns named like the two new ones are replaced; an empty table stays empty.
    Blocks with more than half of their pieces in open bins are not dealt again: their bins can hardly be filled better.
    """
    rows = rows.select(*[c for c in rows.columns if c.lower() not in ("sequence_id", "offset")])
    is_open, dealt_at, block_of = (unused(rows.columns, n) for n in ("_open", "_dealt", "_block"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    names = rows.columns
    rows, done, turn = cut_lineage(rows), None, 0
    while True:
        n = rows.count()
        blocks = max(1, math.ceil(n / BLOCK))
        base = turn << 56  # a function is pickled when it is given to Spark, so each turn has its own

        def run(key: tuple, table: pa.Table) -> pa.Table:
            table = table.sort_by(dealt_at)
            length = table.column(length_column).to_numpy().astype(np.int64)
            if len(length) and not 1 <= length.min() <= length.max() <= capacity:
                raise ValueError(f"lengths must be from 1 to {capacity}")
            # Order of arrival: dealt order, the shortest last.
            late = length <= np.quantile(length, LAST)
            order = np.concatenate([np.flatnonzero(~late), np.flatnonzero(late)])
            table, length = table.take(order), length[order]
            bins, offsets, gaps = sum_of_squares(length, capacity)
            ids = base + (key[0].as_py() << 20) + bins
            table = table.select(names).append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(offsets))
            table = table.append_column(is_open, pa.array(gaps[bins] > 0))
            release()
            return table

        # Rows are checkpointed, so their numbers don't change when a task runs again.
        dealt = rows.withColumn(dealt_at, F.xxhash64(F.monotonically_increasing_id(), F.lit(turn))).withColumn(block_of, F.pmod(dealt_at, F.lit(blocks)))
        placed = cut_lineage(dealt.groupBy(block_of).applyInArrow(run, f"{kinds}, sequence_id long, offset long, `{is_open}` boolean"))
        left = placed.where(F.col(is_open)).count()
        if blocks == 1 or 2 * left > n:
            placed = placed.drop(is_open)
            return placed if done is None else done.unionByName(placed)
        closed = placed.where(~F.col(is_open)).drop(is_open)
        done = closed if done is None else done.unionByName(closed)
        rows, turn = placed.where(F.col(is_open)).select(*names), turn + 1


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids) of rows with ``ids``: the tokens of each sequence in order, at most the capacity."""
    parts = F.sort_array(F.collect_list(F.struct("offset", F.hex("ids").alias("ids"))))
    return packed.groupBy("sequence_id").agg(F.unhex(F.array_join(F.transform(parts, lambda p: p["ids"]), "")).alias("ids"))
