"""Repeated byte strings by a depth-limited radix sort of suffixes.

Every string of ``DEPTH`` bytes holds at least one anchor: the ``GRAM``-byte start
of a suffix whose fingerprint is the smallest among those inside the string. Equal
strings hold equal anchors, so only suffixes at anchors are sorted:

1. First digit: the gram. Batches of documents send the low 32 bits of their grams
   to parts by the high bits; grams seen in one document only leave. (A collision only
   lets a gram stay.)
2. Further digits, byte by byte to the threshold: what stays is sorted by gram and the bytes
   after it and, mirrored, by gram and the bytes before it. Neighbours that agree in so many bytes
   form the groups of each depth, and a group of ``left`` and ``right`` depths that sum
   to the threshold is exactly one repeated string.

Copies inside a batch are one record, so a common passage costs a record a
batch. Grams with very many different surroundings are sorted by whole strings instead,
which spreads them over parts. Nothing is sorted deeper than ``DEPTH`` bytes.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociq.llm.text import INVERSE, buffer, mix, powers, prefix_sums, release, span_hashes, unused
from lociq.session import cut_lineage, use_checkpoint_folder

DEPTH = 50
GRAM = 25
SIDE = DEPTH - GRAM
#: Bytes of text of a batch, grams of a part and records of a part, on average.
BATCH_BYTES, PART_GRAMS, PART_RECORDS = 2 << 20, 600_000, 50_000
#: Bytes of text whose fingerprints are made at a time.
CHUNK = 1 << 18
#: Buckets of the table of texts at most (Spark refuses more than 100,000); further batches share them.
MAX_BUCKETS = 20_000
#: A gram in more batches than this is sorted by whole strings.
HOT_BATCHES = 512


def anchors(codes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place and gram fingerprint of each anchor of some documents."""
    n = len(codes) - GRAM + 1
    if n < SIDE + 1:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    sums = prefix_sums(codes)
    shift = powers(len(sums), INVERSE)
    grams = mix((sums[GRAM:] - sums[:n]) * shift[:n]) | np.uint64(1)
    # Strings that begin here and end in the same document.
    row_end = np.repeat(bounds[1:], np.diff(bounds))
    whole = np.arange(len(codes) - DEPTH + 1) + DEPTH <= row_end[: len(codes) - DEPTH + 1]
    least = slide(grams, SIDE + 1, np.minimum)
    least = np.where(whole, least, 0)
    padded = np.concatenate([np.zeros(SIDE, np.uint64), least, np.zeros(SIDE, np.uint64)])
    at = np.flatnonzero(slide(padded, SIDE + 1, np.maximum)[:n] == grams)
    return at, grams[at]


def slide(x: np.ndarray, size: int, least: np.ufunc) -> np.ndarray:
    """The minimum or maximum of each ``size`` numbers in a row."""
    step = 1
    while 2 * step <= size:
        x = least(x[:-step], x[step:])
        step *= 2
    return least(x[: len(x) - (size - step)], x[size - step :]) if size > step else x


class Batch:
    """The documents of a batch in order of id, their anchors and where each document lies."""

    def __init__(self, table: pa.Table):
        table = table.combine_chunks().sort_by("id")
        self.table = table
        self.ids = table.column("id").to_numpy()
        text = table.column("text")
        self.codes, self.bounds = buffer(text.chunk(0) if text.num_chunks else pa.array([], pa.string()))
        found, row = [(np.zeros(0, np.int64), np.zeros(0, np.uint64))], 0
        while row < len(self.ids):  # some documents at a time: the tables of a byte are many
            end = max(row + 1, int(np.searchsorted(self.bounds, self.bounds[row] + CHUNK, "right")) - 1)
            base = self.bounds[row]
            at, grams = anchors(self.codes[base : self.bounds[end]], self.bounds[row : end + 1] - base)
            found.append((at + base, grams))
            row = end
        self.at, self.grams = (np.concatenate([f[k] for f in found]) for k in (0, 1))
        self.row = np.searchsorted(self.bounds, self.at, "right") - 1
        self.distinct, self.of = np.unique(self.grams, return_inverse=True)

    def requests(self, parts: int) -> list[dict]:
        """Distinct grams by part, and whether two ids of the batch have them."""
        low, high = np.full(len(self.distinct), np.iinfo(np.int64).max), np.full(len(self.distinct), np.iinfo(np.int64).min)
        np.minimum.at(low, self.of, self.ids[self.row])
        np.maximum.at(high, self.of, self.ids[self.row])
        cut = np.searchsorted(part_of(self.distinct, parts), np.arange(parts + 1))
        bits = self.distinct.astype(np.uint32)
        return [{"part": p, "grams": bits[a:b].tobytes(), "several": np.packbits((low < high)[a:b]).tobytes()} for p, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if a < b]

    def shared(self, replies: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """For each anchor: whether its gram occurs in another document, and whether in very many batches."""
        out = np.zeros((2, len(self.distinct)), bool)
        at = 0
        for row in replies.sort_by("part").to_pylist():
            for k, name in enumerate(("shared", "hot")):
                out[k, at : at + row["n"]] = np.unpackbits(np.frombuffer(row[name], np.uint8), count=row["n"])
            at += row["n"]
        return out[0][self.of], out[1][self.of]

    def records(self, shared: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct surroundings of the shared anchors that aren't hot.

        Returns the anchors in question, the record of each, and of each record
        the anchor that stands for it (of the smallest id), the gram and ``2 * SIDE + 2`` bytes:
        the bytes before (nearest first), the bytes after, and how many of each are in the document.
        """
        pick = np.flatnonzero(shared & ~hot)
        at, row = self.at[pick], self.row[pick]
        before = np.minimum(at - self.bounds[row], SIDE)
        after = np.minimum(self.bounds[row + 1] - at - GRAM, SIDE)
        around = np.zeros((len(pick), 2 * SIDE + 2), np.uint8)
        for k in range(SIDE):
            around[:, k] = np.where(k < before, self.codes[np.maximum(at - 1 - k, 0)], 0)
            around[:, SIDE + k] = np.where(k < after, self.codes[np.minimum(at + GRAM + k, len(self.codes) - 1)], 0)
        around[:, 2 * SIDE], around[:, 2 * SIDE + 1] = before, after
        key = np.concatenate([self.grams[pick].astype(">u8").view(np.uint8).reshape(-1, 8), around], axis=1)
        words = np.concatenate([key, np.zeros((len(key), -key.shape[1] % 8), np.uint8)], axis=1).view(">u8").astype(np.uint64)
        order = np.lexsort([np.arange(len(pick)), *words.T[::-1]])
        new = np.ones(len(pick), bool)
        new[1:] = (words[order[1:]] != words[order[:-1]]).any(axis=1)
        record = np.empty(len(pick), np.int64)
        record[order] = np.cumsum(new) - 1
        first = order[new]  # anchors are in order of id, and the sort keeps that
        return pick, record, pick[first], self.grams[pick[first]], around[first]

    def strings(self, shared: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Places of the whole strings around hot anchors, the number of each among the distinct, their two fingerprints, and the smallest id of each."""
        pick = np.flatnonzero(shared & hot)
        starts = np.unique((self.at[pick][:, None] - np.arange(SIDE + 1)).ravel())
        starts = starts[starts >= 0]
        row = np.searchsorted(self.bounds, starts, "right") - 1
        starts = starts[starts + DEPTH <= self.bounds[row + 1]]
        sums = prefix_sums(self.codes) if len(starts) else np.zeros(1, np.uint64)
        one = span_hashes(sums, starts, starts + DEPTH)
        two = mix(span_hashes(sums, starts, starts + GRAM) + mix(span_hashes(sums, starts + GRAM, starts + DEPTH)))
        key, first, of = np.unique(np.stack([one, two], 1), axis=0, return_index=True, return_inverse=True) if len(starts) else (np.zeros((0, 2), np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        row = np.searchsorted(self.bounds, starts, "right") - 1
        return starts, of.ravel(), key, self.ids[row[first]]


def part_of(grams: np.ndarray, parts: int) -> np.ndarray:
    """Part of each fingerprint, by its high bits, so that sorted fingerprints are sorted by part."""
    return (((grams >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)


def first_digit(key: tuple, table: pa.Table, most: int) -> pa.Table:
    """For one part: which grams of each batch occur in two documents or more, and which in more than ``most`` batches."""
    grams = [np.frombuffer(x.as_buffer(), np.uint32) for x in table.column("grams")]
    several = [np.unpackbits(np.frombuffer(x.as_buffer(), np.uint8), count=len(g)) for x, g in zip(table.column("several"), grams, strict=True)]
    _, of, count = np.unique(np.concatenate(grams), return_inverse=True, return_counts=True)
    twice = count > 1
    twice[of[np.concatenate(several).astype(bool)]] = True
    hot = count > most
    cuts = np.cumsum([len(g) for g in grams])[:-1]
    shared, hot = np.split(twice[of], cuts), np.split(hot[of], cuts)
    return pa.table(
        {
            "batch": table.column("batch"), "part": pa.array([key[0].as_py()] * len(grams), pa.int64()), "n": pa.array([len(g) for g in grams], pa.int64()),
            "stay": pa.array([int(s.sum()) for s in shared], pa.int64()),
            "shared": pa.array([np.packbits(s).tobytes() for s in shared], pa.binary()), "hot": pa.array([np.packbits(s).tobytes() for s in hot], pa.binary()),
        }
    )


def groups(grams: np.ndarray, side: np.ndarray) -> np.ndarray:
    """Number of each row's group at depths 0 to ``SIDE``: rows whose gram and first bytes of ``side`` are equal."""
    padded = np.concatenate([side, np.zeros((len(side), -SIDE % 8), np.uint8)], axis=1)
    words = np.ascontiguousarray(padded).view(">u8").astype(np.uint64)
    order = np.lexsort([*words.T[::-1], grams])
    a, b = side[order[1:]], side[order[:-1]]
    differ = a != b
    agree = np.where(differ.any(axis=1), differ.argmax(axis=1), SIDE)
    agree = np.where(grams[order[1:]] == grams[order[:-1]], agree, -1)
    out = np.empty((SIDE + 1, len(side)), np.int64)
    for depth in range(SIDE + 1):
        out[depth, order] = np.concatenate([[0], np.cumsum(agree < depth)])
    return out


def earlier(keys: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Whether a row with the same key has a smaller id."""
    order = np.lexsort([ids, keys])
    new = np.ones(len(keys), bool)
    new[1:] = keys[order[1:]] != keys[order[:-1]]
    least = ids[order][np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))]
    out = np.empty(len(keys), bool)
    out[order] = least < ids[order]
    return out


def further_digits(key: tuple, table: pa.Table) -> pa.Table:
    """For one part: bits of each record, bit k for the string that begins k bytes before the gram, set if it also starts in a document with a smaller id."""
    load = lambda name, kind: [np.frombuffer(x.as_buffer(), kind) for x in table.column(name)]
    counts = [len(x) // 8 for x in (v.as_buffer().to_pybytes() for v in table.column("ids"))]
    ids, grams = np.concatenate(load("ids", np.int64)), np.concatenate(load("grams", np.uint64))
    if table.column("whole")[0].as_py():
        two = np.concatenate(load("around", np.uint64))
        _, of = np.unique(np.stack([grams, two], 1), axis=0, return_inverse=True)
        bits = earlier(of.ravel(), ids).astype(np.uint32)
    else:
        around = np.concatenate(load("around", np.uint8)).reshape(-1, 2 * SIDE + 2)
        before, after = around[:, 2 * SIDE], around[:, 2 * SIDE + 1]
        left, right = groups(grams, around[:, :SIDE]), groups(grams, around[:, SIDE : 2 * SIDE])
        bits = np.zeros(len(ids), np.uint32)
        for k in range(SIDE + 1):
            fits = np.flatnonzero((before >= k) & (after >= SIDE - k))
            bits[fits] |= earlier((left[k, fits] << 32) | right[SIDE - k, fits], ids[fits]).astype(np.uint32) << np.uint32(k)
    cuts = np.cumsum(counts)[:-1]
    n = table.num_rows
    return pa.table({"batch": table.column("batch"), "part": pa.array([key[0].as_py()] * n, pa.int64()), "whole": table.column("whole"), "bits": pa.array([b.tobytes() for b in np.split(bits, cuts)], pa.binary())})


def _spread(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Order by part, and where each part begins."""
    part = part_of(keys, parts)
    order = np.argsort(part, kind="stable")
    return order, np.searchsorted(part[order], np.arange(parts + 1))


def _ask(batch: Batch, shared: np.ndarray, hot: np.ndarray, parts: int) -> list[dict]:
    """Rows (part, whole, grams, around, ids) of a batch for ``further_digits``."""
    _, _, stands, grams, around = batch.records(shared, hot)
    _, _, key, least = batch.strings(shared, hot)
    out = []
    for whole, one, two, ids in ((False, grams, around, batch.ids[batch.row[stands]]), (True, key[:, 0], key[:, 1], least)):
        order, cut = _spread(one, parts)
        one, two, ids = one[order], two[order], ids[order].astype(np.int64)
        out += [{"part": 2 * p + whole, "whole": whole, "grams": one[a:b].tobytes(), "around": two[a:b].tobytes(), "ids": ids[a:b].tobytes()} for p, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if a < b]
    return out


def _repeated(batch: Batch, shared: np.ndarray, hot: np.ndarray, parts: int, replies: pa.Table) -> np.ndarray:
    """For each byte of a batch, whether it is covered by a string that also starts in a document with a smaller id."""
    pick, record, stands, grams, around = batch.records(shared, hot)
    starts, of, key, least = batch.strings(shared, hot)
    rows = replies.sort_by("part").to_pylist()
    got = [np.concatenate([np.zeros(0, np.uint32), *(np.frombuffer(r["bits"], np.uint32) for r in rows if r["whole"] == w)]) for w in (False, True)]
    begins = np.zeros(len(batch.codes) + 1, np.int32)
    bits = np.empty(len(grams), np.uint32)
    bits[_spread(grams, parts)[0]] = got[0]
    # Later documents of the batch repeat the one that stands for the record, wherever a string fits.
    fits = np.zeros(len(grams), np.uint32)
    for k in range(SIDE + 1):
        fits |= ((around[:, 2 * SIDE] >= k) & (around[:, 2 * SIDE + 1] >= SIDE - k)).astype(np.uint32) << np.uint32(k)
    later = batch.ids[batch.row[pick]] > batch.ids[batch.row[stands]][record]
    mask = np.where(later, fits[record], bits[record])
    for k in range(SIDE + 1):
        begins[batch.at[pick[(mask >> np.uint32(k)) & np.uint32(1) == 1]] - k] = 1
    dup = np.empty(len(key), np.uint32)
    dup[_spread(key[:, 0], parts)[0]] = got[1]
    row = np.searchsorted(batch.bounds, starts, "right") - 1
    begins[starts[(dup[of] == 1) | (batch.ids[row] > least[of])]] = 1
    total = np.cumsum(begins[:-1])
    total[DEPTH:] -= total[:-DEPTH].copy()
    return total > 0


def _result(batch: Batch, gone: np.ndarray) -> pa.Table:
    """(id, n_bytes, spans, kept) of the documents of a batch."""
    edges = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
    first, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    # Runs that meet at the border of two documents are two.
    inner = batch.bounds[1:-1][(gone[np.minimum(batch.bounds[1:-1], len(gone) - 1)] & gone[np.maximum(batch.bounds[1:-1] - 1, 0)])] if len(gone) else np.zeros(0, np.int64)
    first, end = np.sort(np.concatenate([first, np.unique(inner)])), np.sort(np.concatenate([end, np.unique(inner)]))
    cut = np.searchsorted(first, batch.bounds)
    row = np.repeat(np.arange(len(batch.bounds) - 1), np.diff(cut))
    spans = pa.StructArray.from_arrays([pa.array(first - batch.bounds[row]), pa.array(end - first)], names=["start", "bytes"])
    left = batch.codes[~gone]
    ends = np.concatenate([[0], np.cumsum(~gone)])[batch.bounds]
    raw = left.tobytes()
    kept = pa.array([raw[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.binary())
    carried = {n: batch.table.column(n) for n in batch.table.column_names if n not in ("id", "text", "batch")}
    return pa.table({"id": batch.table.column("id"), **carried, "n_bytes": pa.array(np.diff(batch.bounds)), "spans": pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), spans), "kept": kept})


def repeated_spans(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """(id, carried columns, n_bytes, spans, kept) per row: the maximal runs (start, bytes) of bytes covered by a ``DEPTH``-byte string that also starts in a document with a smaller id, and the remaining bytes.

    A null text is empty. Rows with a null id are compared with nothing and stay
    whole; rows with one id count as one document and don't repeat each other.
    """
    spark = docs.sparkSession
    carried = {c: f"c{k}" for k, c in enumerate(carry)}  # names of their own: the steps have columns too
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"), *(F.col(c).alias(n) for c, n in carried.items()))
    total = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    batches = max(1, math.ceil(total / BATCH_BYTES))
    buckets = min(MAX_BUCKETS, max(1, math.ceil(batches / 4)))
    parts = max(1, math.ceil(total * 2 / (SIDE + 2) / PART_GRAMS))
    name = f"radix_{uuid.uuid4().hex}"
    dealt = rows.where("id IS NOT NULL").withColumn("batch", F.pmod(F.xxhash64("id", "text"), F.lit(batches)))
    # A bucketed table: the later steps read whole batches without moving texts again.
    dealt.repartition(buckets, "batch").write.bucketBy(buckets, "batch").option("path", f"{use_checkpoint_folder(spark).rstrip('/')}/{name}").option("compression", "zstd").saveAsTable(name)
    texts = spark.table(name)

    def send_grams(key: tuple, table: pa.Table) -> pa.Table:
        sent = Batch(table).requests(parts)
        release()
        return pa.Table.from_pylist([{"batch": key[0].as_py(), **r} for r in sent], pa.schema([("batch", pa.int64()), ("part", pa.int64()), ("grams", pa.binary()), ("several", pa.binary())]))

    most = HOT_BATCHES

    def told_grams(key: tuple, table: pa.Table) -> pa.Table:
        told = first_digit(key, table, most)
        release()
        return told

    grams = texts.groupBy("batch").applyInArrow(send_grams, "batch long, part long, grams binary, several binary")
    told = cut_lineage(grams.groupBy("part").applyInArrow(told_grams, "batch long, part long, n long, stay long, shared binary, hot binary"))
    more = max(1, math.ceil((told.agg(F.sum("stay")).first()[0] or 0) / PART_RECORDS))

    def send_records(key: tuple, table: pa.Table, replies: pa.Table) -> pa.Table:
        batch = Batch(table)
        sent = _ask(batch, *batch.shared(replies), more)
        release()
        return pa.Table.from_pylist([{"batch": key[0].as_py(), **r} for r in sent], pa.schema([("batch", pa.int64()), ("part", pa.int64()), ("whole", pa.bool_()), ("grams", pa.binary()), ("around", pa.binary()), ("ids", pa.binary())]))

    def told_records(key: tuple, table: pa.Table) -> pa.Table:
        bits = further_digits(key, table)
        release()
        return bits

    records = texts.groupBy("batch").cogroup(told.groupBy("batch")).applyInArrow(send_records, "batch long, part long, whole boolean, grams binary, around binary, ids binary")
    bits = records.groupBy("part").applyInArrow(told_records, "batch long, part long, whole boolean, bits binary")
    none = F.lit(None).cast("binary")
    replies = told.select("batch", "part", F.lit(0).alias("step"), "n", "shared", "hot", F.lit(False).alias("whole"), none.alias("bits"))
    replies = cut_lineage(replies.unionByName(bits.select("batch", "part", F.lit(1).alias("step"), F.lit(0).cast("long").alias("n"), none.alias("shared"), none.alias("hot"), "whole", "bits")))

    def finish(key: tuple, table: pa.Table, replies: pa.Table) -> pa.Table:
        batch = Batch(table)
        step = replies.column("step").to_numpy()
        shared, hot = batch.shared(replies.filter(pa.array(step == 0)))
        out = _result(batch, _repeated(batch, shared, hot, more, replies.filter(pa.array(step == 1))))
        release()
        return out

    kinds = "".join(f"{n} {docs.schema[c].dataType.simpleString()}, " for c, n in carried.items())
    schema = f"id long, {kinds}n_bytes long, spans array<struct<start: long, bytes: long>>, kept binary"
    found = texts.groupBy("batch").cogroup(replies.groupBy("batch")).applyInArrow(finish, schema)
    alone = rows.where("id IS NULL").select("id", *carried.values(), F.octet_length("text").cast("long").alias("n_bytes"), F.expr("cast(array() AS array<struct<start: bigint, bytes: bigint>>)").alias("spans"), F.encode("text", "UTF-8").alias("kept"))
    return found.unionByName(alone).withColumnsRenamed({"id": id_column, **{n: c for c, n in carried.items()}})


def without_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with the repeated spans cut out of the text.

    A character of which a byte goes, goes. Rows of which nothing but white space is left are dropped; rows that lose nothing are as they were.
    """
    names = docs.columns
    others = [c for c in names if c not in (id_column, text_column)]
    inner = [f"in{k}" for k in range(len(names))]
    empty = unused(names, "_null")
    # Spans and remaining bytes get names of their own, too.
    found = repeated_spans(docs.withColumn(empty, F.col(text_column).isNull()).withColumnsRenamed(dict(zip(names, inner, strict=True))), inner[names.index(id_column)], inner[names.index(text_column)], [*(inner[names.index(c)] for c in others), empty])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for kept, spans, null in zip(batch.column("kept"), batch.column("spans").to_pylist(), batch.column(empty).to_pylist(), strict=True):
                raw, at, gone, parts = kept.as_buffer().to_pybytes(), 0, 0, []
                for span in spans:
                    end = span["start"] - gone
                    parts.append(raw[at:end].decode("utf-8", "ignore"))
                    at, gone = end, gone + span["bytes"]
                text = "".join([*parts, raw[at:].decode("utf-8", "ignore")])
                texts.append(None if null else text if not spans or text.strip() else "")
            keep = pa.array([not s or bool(t) for s, t in zip(batch.column("spans").to_pylist(), texts, strict=True)], pa.bool_())
            columns = [pa.array(texts, pa.string()) if c == text_column else batch.column(i) for c, i in zip(names, inner, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(keep)

    kinds = ", ".join(f"`{f.name}` {'bigint' if f.name == id_column else f.dataType.simpleString()}" for f in docs.schema)
    return found.mapInArrow(run, kinds)
