"""Ranked lexical search over classes of equal bags instead of over documents.

Documents are restricted to the vocabulary of the items. Those with the same
counts of these terms and the same length term ``m`` have the same score for
every item, so they are one class: found by a hash of both and told apart by
the whole bag. Classes are scored once, and only the best ones are expanded
into members, by ascending id.

Items are asked in blocks of about ``ITEM_BYTES`` of text. What is sent to tasks is the
index of one block; what a task holds is its ``k`` best classes of each item.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lociq.llm.text import ALNUM, buffer, slices, words_of
from lociq.operators.joins import salted_join
from lociq.session import cut_lineage, use_checkpoint_folder

#: Bytes of item text of a block.
ITEM_BYTES = 2 << 20
#: Scores, and terms met, that a task works on at a time.
CELLS, MEETINGS = 1 << 20, 1 << 20
#: Bytes of chosen bags up to which they are sent to every task.
BROADCAST_BYTES = 32 << 20
#: A null id is ordered as this.
LAST = (1 << 63) - 1


@dataclass
class Items:
    """The items of a block: their row numbers, the sorted fingerprints of their terms, and the items (and how often) of each term."""

    rows: np.ndarray
    terms: np.ndarray
    first: np.ndarray
    item: np.ndarray
    times: np.ndarray


def index_items(rows: np.ndarray, texts: pa.Array) -> Items:
    """Postings of the terms of some items."""
    words = words_of(texts, ALNUM)
    terms, of = np.unique(words.hash, return_inverse=True)
    pair, times = np.unique(of.astype(np.int64) * max(1, len(rows)) + words.row(), return_counts=True)
    term, item = np.divmod(pair, max(1, len(rows)))
    return Items(rows, terms, np.searchsorted(term, np.arange(len(terms) + 1)), item, times.astype(np.int64))


def bags(batches: Iterator[pa.RecordBatch], items: Broadcast) -> Iterator[pa.RecordBatch]:
    """(id, n, bag) of each text: how many terms it has, and the pairs (number of an item term, occurrences) in order."""
    terms = items.value.terms
    for batch in batches:
        for part in slices(batch, "text"):
            words = words_of(part.column("text"), ALNUM)
            at = np.minimum(np.searchsorted(terms, words.hash), len(terms) - 1)
            hit = terms[at] == words.hash
            pair, times = np.unique(words.row()[hit] * len(terms) + at[hit], return_counts=True)
            row, term = np.divmod(pair, len(terms))
            cut = np.searchsorted(row, np.arange(part.num_rows + 1)) * 8
            raw = np.stack([term, times], 1).astype("<u4").tobytes()
            bag = pa.array([raw[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(np.diff(words.first).astype(np.int64)), bag], names=["id", "n", "bag"])


def unpacked(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and occurrences of all pairs of a column of bags."""
    codes, bounds = buffer(part.column("bag"))
    pairs = np.frombuffer(codes.tobytes(), "<u4").reshape(-1, 2).astype(np.int64)
    return np.repeat(np.arange(part.num_rows), np.diff(bounds) // 8), pairs[:, 0], pairs[:, 1]


def holders(batches: Iterator[pa.RecordBatch], terms: int) -> Iterator[pa.RecordBatch]:
    """(term, df): documents of the classes that hold each term."""
    df = np.zeros(terms, np.int64)
    for batch in batches:
        for part in slices(batch, "bag"):
            row, term, _ = unpacked(part)
            np.add.at(df, term, part.column("size").to_numpy()[row])
    held = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(df[held])], names=["term", "df"])


class Best:
    """The ``k`` best (score, then smallest id, then class) of each item."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.item, self.score, self.first, self.cls = (np.zeros(0, np.int64) for _ in range(4))
        self.least = np.ones(items, np.int64)

    def add(self, item: np.ndarray, score: np.ndarray, first: np.ndarray, cls: np.ndarray) -> None:
        """Take candidates in; ``least`` is what a score must reach from now on."""
        item, score, first, cls = (np.concatenate(x) for x in ((self.item, item), (self.score, score), (self.first, first), (self.cls, cls)))
        order = np.lexsort([cls, first, -score, item])
        item = item[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        keep = order[place < self.k]
        full = place == self.k - 1
        self.least[item[full]] = score[order[full]]
        self.item, self.score, self.first, self.cls = item[place < self.k], score[keep], first[keep], cls[keep]


def best_classes(batches: Iterator[pa.RecordBatch], items: Broadcast, weights: Broadcast, k: int) -> Iterator[pa.RecordBatch]:
    """(row, score, first, cls): for each item the ``k`` best of the classes of a partition with a score above 0."""
    asked: Items = items.value
    n_items, many = len(asked.rows), np.diff(asked.first)
    gain = asked.times * np.repeat(weights.value, many)
    found = Best(n_items, k)
    for batch in batches:
        for part in slices(batch, "bag"):
            row, term, tf = unpacked(part)
            m, first, cls = (part.column(c).to_numpy() for c in ("m", "first", "cls"))
            worth = (1_000_000_000 * tf) // (1000 * tf + 8 * m[row])
            met = np.concatenate([[0], np.cumsum(many[term])])
            begin = np.searchsorted(row, np.arange(part.num_rows + 1))
            at = 0
            while at < part.num_rows:
                end = int(np.searchsorted(met[begin], met[begin[at]] + MEETINGS, "right")) - 1
                end = max(at + 1, min(end, at + max(1, CELLS // n_items)))
                a, b = begin[at], begin[end]
                pair = np.repeat(np.arange(a, b), many[term[a:b]])
                post = np.arange(len(pair)) - (met[pair] - met[a]) + asked.first[term[pair]]
                score = np.zeros((end - at) * n_items, np.int64)
                np.add.at(score, (row[pair] - at) * n_items + asked.item[post], worth[pair] * gain[post])
                hit = np.flatnonzero(score.reshape(-1, n_items) >= found.least)
                of, item = np.divmod(hit, n_items)
                found.add(item, score[hit], first[at + of], cls[at + of])
                at = end
    yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (asked.rows[found.item], found.score, found.first, found.cls)], names=["row", "score", "first", "cls"])


def _block(rows: DataFrame, asked: DataFrame, folder: str, k: int) -> DataFrame:
    """(row, rank, id, score) for the items of a block."""
    spark = rows.sparkSession
    table = asked.select("row", "text").toArrow()
    index = index_items(table.column("row").to_numpy(), table.column("text").combine_chunks())
    none = spark.createDataFrame([], "row long, rank int, id long, score long")
    if not len(index.terms):
        return none
    items = spark.sparkContext.broadcast(index)
    rows.mapInArrow(lambda b: bags(b, items), "id long, n long, bag binary").write.option("compression", "zstd").parquet(f"{folder}/bags")
    held = spark.read.parquet(f"{folder}/bags")
    n_docs, n_terms = held.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
    if not n_docs:
        return none
    held = held.where(F.octet_length("bag") > 0).select(F.coalesce("id", F.lit(LAST)).alias("place"), "id", F.expr(f"100 - 75 + (75 * n * {n_docs}L) div {n_terms}L").alias("m"), "bag")
    held = held.withColumn("h", F.xxhash64("m", "bag"))
    # Copies are combined before the shuffle; equal hashes are told apart by the bag itself.
    grouped = held.groupBy("h", "m", "bag").agg(F.min("place").alias("first"), F.count("*").alias("size"))
    grouped.withColumn("cls", F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(f"{folder}/classes")
    classes = spark.read.parquet(f"{folder}/classes")

    n = len(index.terms)
    df = classes.select("bag", "size").mapInArrow(lambda b: holders(b, n), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    weight = np.zeros(n, np.int64)
    weight[df.column("term").to_numpy()] = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.column("df").to_pylist()]
    weights = spark.sparkContext.broadcast(weight)

    best = classes.select("m", "bag", "first", "cls").mapInArrow(lambda b: best_classes(b, items, weights, k), "row long, score long, first long, cls long")
    # The documents sought are in the k first classes: each class before another has a member before its members.
    order = Window.partitionBy("row").orderBy(F.desc("score"), "first", "cls")
    best = cut_lineage(best.withColumn("_at", F.row_number().over(order)).where(F.col("_at") <= k).select("row", "score", "cls"))
    chosen = cut_lineage(classes.join(best.select("cls").distinct(), "cls", "left_semi").select("h", "m", "bag", "cls"))
    small = (chosen.agg(F.sum(F.octet_length("bag") + 64)).first()[0] or 0) <= BROADCAST_BYTES
    members = held.join(F.broadcast(chosen), ["h", "m", "bag"]) if small else salted_join(held, chosen, ["h", "m", "bag"])
    inside = Window.partitionBy("cls").orderBy("place")
    members = members.select("cls", "place", "id").withColumn("_at", F.row_number().over(inside)).where(F.col("_at") <= k)
    ranked = best.join(members.select("cls", "place", "id"), "cls").withColumn("rank", F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "place")))
    return ranked.where(F.col("rank") <= k).select("row", "rank", "id", "score")


def ranked_search(
    docs: DataFrame, items: DataFrame, k: int = 10, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """(item, rank, id, score): the ``k`` documents with the highest scores above 0 for each row of ``items``, equal scores by ascending id.

    Terms are runs of letters, digits and other characters above ASCII, A-Z
    lower-cased. A null or empty text has none: such an item finds nothing, such a
    document is found by none and not counted. Null ids come after all others;
    repeated ids are documents of their own, repeated items are each answered. Empty
    tables give an empty result, and further columns are ignored.
    """
    spark = docs.sparkSession
    folder = f"{use_checkpoint_folder(spark).rstrip('/')}/search-{uuid.uuid4()}"
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    asked = cut_lineage(items.select(F.col(item_column).alias("item"), F.coalesce(F.col(item_text), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row")))
    blocks = max(1, math.ceil((asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / ITEM_BYTES))
    found = [_block(rows, asked.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == b), f"{folder}/{b}", k) for b in range(blocks)]
    result = reduce(DataFrame.unionByName, found).join(asked.select("row", "item"), "row")
    return result.select(F.col("item").alias(item_column), "rank", F.col("id").alias(id_column), "score")
