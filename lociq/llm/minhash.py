"""Near-duplicates by an inverted join of MinHash coordinates, confirmed on full shingle sets.

A signature has ``VALUES`` coordinates, and a posting list is the documents with one value in one
coordinate. Coordinate-value pairs are ordered from rare to frequent over all documents. Two
signatures with at least T equal values must share one of the first ``VALUES`` - T + 1 of each in
that order, so only this prefix is posted: what a template gives to many pages is at the end
of the order and mostly not posted, and lists of one document are not written. Two passes merge
the lists and neither writes out the pairs inside a group:

1. Star: every member of a list is matched with the smallest id of its list.
   Those confirmed form groups, whatever their size, from one pair a member and list.
2. Rest: lists whose members already are one group are skipped. In the others, members of
   different groups are matched, never those of one group, so a large group beside a few others
   costs what the others number. Collisions are counted a quarter of the signature at a time
   and pairs that can't reach T any more, or whose sizes don't allow the similarity, are skipped;
   the others are kept in the first list they share. Lists are
   cut into tiles of bounded size, whose pairs are counted, confirmed and united
   inside a task, so a tile gives fewer links than it has members.

T is ``matches_for`` the similarity, and all links are confirmed on the full sets. A pair at the
threshold itself has fewer equal values with a probability of at most 1e-6, any nearer
pair with less; a pair with T or more is never missed.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociq.llm.components import components
from lociq.llm.text import SPACED, buffer, mix, release, slices, unused, windows, words_of
from lociq.operators.joins import join_sized, with_ids, without_ids
from lociq.session import cut_lineage, use_checkpoint_folder

VALUES = 64
#: Probability that a pair at the threshold has fewer equal values than are asked for.
MISSED = 1e-6

_SEEDS = mix(np.arange(1, VALUES + 3, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_FACTORS = mix(_SEEDS) | np.uint64(1)
_LANES = [f"s{k}" for k in range(VALUES // 8)]
#: Members and shingles of a block of a posting list, on average; a tile is two blocks.
TILE, TILE_SHINGLES = 1000, 1_000_000
_TILED = "tile long, at int, id long, n_shingles long, " + ", ".join(f"{c} long" for c in _LANES) + ", label long, side int"
_SIGNED = "id long, n_shingles long, whole_a long, whole_b long, " + ", ".join(f"{c} long" for c in _LANES) + ", keys array<long>"


def shingle_sets(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle fingerprints of all rows, and where each row begins; fewer words than ``size`` are one shingle."""
    words = words_of(column, SPACED)
    hashes, at = windows(words, size)
    row = words.row()
    rows = row[at]
    count = np.diff(words.first)
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        whole = np.zeros(len(count), np.uint64)
        for k in range(size - 1):
            has = short[count[short] > k]
            whole[has] = mix(whole[has] + words.hash[words.first[has] + k] + np.uint64(k + 1))
        hashes, rows = np.concatenate([hashes, whole[short]]), np.concatenate([rows, short])
    order = np.lexsort((hashes, rows))
    hashes, rows = hashes[order], rows[order]
    new = np.ones(len(rows), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
    return hashes[new], np.searchsorted(rows[new], np.arange(len(count) + 1))


def sign(docs: DataFrame, size: int) -> DataFrame:
    """Signature of each (id, text): set size, 128-bit fingerprint of the set, packed low bytes of the values, a posting key for each coordinate and its value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets, first = shingle_sets(part.column("text"), size)
                n = np.diff(first)
                some = np.flatnonzero(n)
                values = np.zeros((VALUES, part.num_rows), np.uint64)
                whole = np.zeros((2, part.num_rows), np.uint64)
                if len(some):
                    for k in range(VALUES):
                        values[k, some] = np.minimum.reduceat((sets ^ _SEEDS[k]) * _FACTORS[k], first[some])
                    for k in range(2):
                        whole[k, some] = np.add.reduceat(mix(sets + _SEEDS[VALUES + k]), first[some])
                packed = (mix(values) & np.uint64(255)).astype(np.uint8).T.copy().view(np.int64)
                keys = mix(values + _SEEDS[:VALUES, None])
                keys = pa.ListArray.from_arrays(np.arange(part.num_rows + 1, dtype=np.int32) * VALUES, keys.T.ravel().view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(n), *(pa.array(w.view(np.int64)) for w in whole), *(pa.array(packed[:, k].copy()) for k in range(len(_LANES))), keys],
                    names=["id", "n_shingles", "whole_a", "whole_b", *_LANES, "keys"],
                )
            release()

    return docs.mapInArrow(run, _SIGNED)


def collisions(a: str, b: str) -> str:
    """SQL that counts equal signature values of two postings: bytes that are zero after XOR."""
    terms = []
    for c in _LANES:
        x = f"({a}.{c} ^ {b}.{c})"
        x = f"({x} | shiftrightunsigned({x}, 4))"
        terms.append(f"bit_count(({x} | shiftrightunsigned({x}, 2) | shiftrightunsigned({x}, 1) | shiftrightunsigned({x}, 3)) & 72340172838076673L)")
    return f"{VALUES} - ({' + '.join(terms)})"


def matches_for(percent: int) -> int:
    """Equal signature values to ask for: a pair with just ``percent`` % in common has fewer with a probability of ``MISSED`` at most."""
    p, total, asked = percent / 100, 0.0, 0
    while asked < VALUES:
        total += math.comb(VALUES, asked) * p**asked * (1 - p) ** (VALUES - asked)
        if total > MISSED:
            break
        asked += 1
    return asked


def _near(a: str, b: str, percent: int) -> str:
    """SQL: sizes allow the similarity, and enough signature values collide."""
    sizes = f"least({a}.n_shingles, {b}.n_shingles) * 100 >= greatest({a}.n_shingles, {b}.n_shingles) * {percent}"
    return f"{sizes} AND {collisions(a, b)} >= {matches_for(percent)}"


def prefixes(classes: DataFrame, percent: int) -> DataFrame:
    """Postings (at, key, id) of the rows (id, keys): the ``VALUES`` - T + 1 rarest keys of each, less those that no other row has."""
    postings = classes.select("id", F.posexplode("keys").alias("at", "key"))
    counts = cut_lineage(postings.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    most = counts.agg(F.max("n")).first()[0] or 0
    shared = join_sized(postings, counts.withColumn("rows", F.col("n")), ["key"], "rows", most=most)
    shared = shared.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", "key", "at"))).alias("shared"))
    # Keys of one row come first in the order.
    rarest = F.expr(f"slice(shared, 1, greatest(0, size(shared) - {matches_for(percent) - 1}))")
    return shared.select("id", F.explode(rarest).alias("p")).select("p.at", "p.key", "id")


def shingles(docs: DataFrame, size: int) -> DataFrame:
    """(id, shingles): the sorted distinct fingerprints of each text, one row for each id."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets, first = shingle_sets(part.column("text"), size)
                raw = sets.tobytes()
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([raw[8 * s : 8 * e] for s, e in zip(first[:-1], first[1:], strict=True)], pa.binary())], names=["id", "shingles"])
            release()

    return docs.dropDuplicates(["id"]).mapInArrow(build, "id long, shingles binary")


def confirm(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose full shingle sets have 100 * intersection >= percent * union. Sets are built once per document in question."""
    wanted = cut_lineage(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
            release()

    sets = shingles(with_ids(docs, wanted, "id"), size)
    # A head has a pair with each of its members.
    many = pairs.groupBy("a").agg(F.count("*").alias("members"))
    left = join_sized(pairs, sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")).join(many, "a"), ["a"], "members")
    return left.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b").mapInArrow(compare, "a long, b long")


def rest_links(members: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (a, b) that unite groups: rows (at, key, id, n_shingles, lanes, label) of all posting lists, with the group of each id."""
    tiled = _tiles(members)
    # Which members have a candidate, then which of them in the first list that both are in, by their keys, and then their sets.
    near = cut_lineage(_sorted(tiled).mapInArrow(partial(_in_tiles, percent=percent, kept=None), _TILED))
    posted = members.join(near.select("id").distinct(), "id", "left_semi").groupBy("id", "at").agg(F.min("key").alias("key"))
    posted = posted.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("at", "key"))).alias("of"))
    posted = posted.select("id", F.transform(F.sequence(F.lit(0), F.lit(VALUES - 1)), lambda c: F.coalesce(F.element_at("of", c), F.lit(0))).alias("keys"))
    open_rows = _sorted(near.join(posted, "id").select(*near.columns, "keys"))
    open_rows = cut_lineage(open_rows.mapInArrow(partial(_in_tiles, percent=percent, kept=None), f"{_TILED}, keys array<long>"))
    sets = shingles(with_ids(texts, cut_lineage(open_rows.select("id").distinct()), "id"), size)
    return _sorted(open_rows.join(sets, "id")).mapInArrow(partial(_in_tiles, percent=percent, kept="shingles"), "a long, b long")


def _tiles(members: DataFrame) -> DataFrame:
    """Rows of the posting lists with several groups, in tiles of two blocks.

    Blocks of the largest group of a list meet the blocks of the others but not each other, so its rows are in as many tiles as the others need.
    """
    groups = members.groupBy("key", "label").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("total"))
    lists = groups.groupBy("key").agg(F.max(F.struct("n", "total", "label")).alias("main"), F.count("*").alias("groups"), F.sum("n").alias("n"), F.sum("total").alias("total"))
    blocks = lambda n, total: F.greatest(F.ceil(n / TILE), F.ceil(total / TILE_SHINGLES), F.lit(1)).cast("int")
    lists = lists.where("groups > 1").select(
        "key", F.col("main.label").alias("main"), blocks(F.col("main.n"), F.col("main.total")).alias("mains"), blocks(F.col("n") - F.col("main.n"), F.col("total") - F.col("main.total")).alias("others"), F.col("n").alias("rows")
    )
    rows = join_sized(members, lists, ["key"], "rows")
    inside, place = F.col("label") == F.col("main"), F.xxhash64("id")
    rows = rows.withColumn("block", F.when(inside, F.col("others") + F.pmod(place, F.col("mains"))).otherwise(F.pmod(place, F.col("others"))).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("others") - 1 + F.when(inside, 0).otherwise(F.col("mains")))))
    tile = F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")).alias("tile")
    return rows.select(tile, "at", "id", "n_shingles", *_LANES, "label", F.signum(F.col("block") - F.col("other")).cast("int").alias("side"))


def _sorted(tiled: DataFrame) -> DataFrame:
    """Whole tiles, in each the first block before the second and the rows of a group together."""
    return tiled.repartition("tile").sortWithinPartitions("tile", "side", "label", "id")


def _in_tiles(batches: Iterator[pa.RecordBatch], percent: int, kept: str | None) -> Iterator[pa.RecordBatch]:
    """Rows sorted by tile: those with a candidate partner (``kept`` None), or the links that unite groups, confirmed on the column ``kept``.

    Rows with ``keys`` are matched in the first list that both are in, others in every list.
    """
    asked, quarter = matches_for(percent), VALUES // 4
    rest: pa.Table | None = None
    for batch in chain(batches, [None]):
        table = rest if batch is None else pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        if table is None or not table.num_rows:
            continue
        tile = table.column("tile").to_numpy()
        edge = np.flatnonzero(np.diff(tile)) + 1
        whole = table.num_rows if batch is None else int(edge[-1]) if len(edge) else 0
        rest = table.slice(whole)
        table = table.slice(0, whole).combine_chunks()
        first = np.concatenate([[0], edge[edge < whole], [whole]]).astype(np.int64)
        if not whole:
            continue
        lanes = np.stack([table.column(c).to_numpy() for c in _LANES], 1)
        values = np.ascontiguousarray(lanes).view(np.uint8).reshape(-1, VALUES)
        n, label, side, at, ids = (table.column(c).to_numpy() for c in ("n_shingles", "label", "side", "at", "id"))
        keys = pc.list_flatten(table.column("keys")).to_numpy().reshape(-1, VALUES) if "keys" in table.column_names else None
        # Pairs are used as they are found, so only the members of the batch and one block of pairs are in memory.
        wanted = np.zeros(whole, bool)
        sets, group, links = None if kept is None else table.column(kept), {}, []
        binned = None if sets is None else _binned(sets)
        for x, y in _pairs(*_partners(first, side, label)):
            fits = (label[x] != label[y]) & (np.minimum(n[x], n[y]) * 100 >= np.maximum(n[x], n[y]) * percent)
            x, y = x[fits], y[fits]
            hits = np.zeros(len(x), np.int64)
            for c in range(0, VALUES, quarter):
                hits += (values[x, c : c + quarter] == values[y, c : c + quarter]).sum(1)
                able = hits + (VALUES - c - quarter) >= asked
                x, y, hits = x[able], y[able], hits[able]
            if keys is not None:
                mine = _first_shared(keys, x, y) == at[x]
                x, y = x[mine], y[mine]
            if sets is None:
                wanted[x] = wanted[y] = True
                continue
            able = _may_share(binned, x, y, percent)
            x, y = x[able], y[able]
            tiles = np.searchsorted(first, x, "right")
            for t, i, j in zip(tiles.tolist(), x.tolist(), y.tolist(), strict=True):
                one, two = _root(group, (t, label[i])), _root(group, (t, label[j]))
                if one != two:
                    a, b = (np.frombuffer(sets[k].as_buffer(), np.uint64) for k in (i, j))
                    both = int((a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b).sum())
                    if 100 * both >= percent * (len(a) + len(b) - both):
                        group[one] = two
                        links.append((ids[i], ids[j]))
        if sets is None:
            # Only the rows that go on are copied; a slice of them at a time is handed on.
            yield from table.take(pa.array(np.flatnonzero(wanted))).to_batches(max_chunksize=1000)
        else:
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])
        del table, lanes, values, sets, binned
        release()


def _binned(sets: pa.ChunkedArray, rows: int = 1000, bins: int = 256) -> np.ndarray:
    """Shingles of each set in each of ``bins`` parts of the fingerprints."""
    out = np.zeros((len(sets), bins), np.int32)
    for at in range(0, len(sets), rows):
        codes, bounds = buffer(pa.concat_arrays(sets.slice(at, rows).chunks))
        part = np.repeat(np.arange(len(bounds) - 1) * bins, np.diff(bounds) // 8) + (codes.view(np.uint64) >> np.uint64(56)).astype(np.int64)
        out[at : at + rows] = np.bincount(part, minlength=(len(bounds) - 1) * bins).reshape(-1, bins)
    return out


def _first_shared(keys: np.ndarray, x: np.ndarray, y: np.ndarray, pairs: int = 10_000) -> np.ndarray:
    """The first coordinate in which the rows of each pair are in one list; a few pairs at a time, as each takes a kilobyte."""
    out = np.zeros(len(x), np.int64)
    for at in range(0, len(x), pairs):
        i, j = keys[x[at : at + pairs]], keys[y[at : at + pairs]]
        out[at : at + pairs] = ((i == j) & (i != 0)).argmax(axis=1)
    return out


def _may_share(binned: np.ndarray, x: np.ndarray, y: np.ndarray, percent: int, pairs: int = 10_000) -> np.ndarray:
    """Pairs that can have the similarity: two sets share at most the smaller count of each bin."""
    able, size = np.zeros(len(x), bool), binned.sum(1)
    for at in range(0, len(x), pairs):
        i, j = x[at : at + pairs], y[at : at + pairs]
        most = np.minimum(binned[i], binned[j]).sum(1)
        able[at : at + pairs] = 100 * most >= percent * (size[i] + size[j] - most)
    return able


def _partners(first: np.ndarray, side: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows that each row meets, as (from, to): in a tile of two blocks those of the second, in a tile of one those of later groups."""
    end = np.repeat(first[1:], np.diff(first))
    new = np.ones(len(side), bool)
    new[1:] = (end[1:] != end[:-1]) | (side[1:] != side[:-1]) | ((side[1:] == 0) & (label[1:] != label[:-1]))
    start = np.flatnonzero(new)
    after = np.repeat(np.append(start[1:], len(side)), np.diff(np.append(start, len(side))))
    return np.where(side > 0, end, after), end


def _pairs(start: np.ndarray, end: np.ndarray, limit: int = 200_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each row with the rows ``start[k]:end[k]``, about ``limit`` pairs at a time."""
    many = end - start
    total = np.cumsum(many)
    at = 0
    while at < len(end):
        before = total[at - 1] if at else 0
        last = max(at + 1, int(np.searchsorted(total, before + limit, "right")))
        x = np.repeat(np.arange(at, last), many[at:last])
        if len(x):
            yield x, np.arange(len(x)) - np.repeat(total[at:last] - many[at:last] - before, many[at:last]) + start[x]
        at = last


def _root(group: dict, x: tuple) -> tuple:
    while x in group:
        if group[x] in group:
            group[x] = group[group[x]]
        x = group[x]
    return x


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", size: int = 3, percent: int = 85) -> DataFrame:
    """(id, n_shingles, component_id) per row: components of documents with ``percent`` % of their shingles in common.

    Words are lower-cased (A-Z) runs without white space; a text with fewer words
    than ``size`` is one shingle; one without words (empty, null) has none and is
    linked with nothing. Equal sets are one class throughout and never expanded
    into pairs. Rows with a null id or text stand alone (component_id is the
    id); rows with one id are taken as copies of that document and each comes back.
    """
    texts = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    signed = cut_lineage(sign(texts, size))
    whole = ["whole_a", "whole_b", "n_shingles"]
    # Equal sets are one class with the smallest id.
    classes = cut_lineage(signed.where("n_shingles > 0 AND id IS NOT NULL").groupBy(*whole, *_LANES, "keys").agg(F.min("id").alias("id")))
    posted = cut_lineage(prefixes(classes, percent).join(classes.select("id", "n_shingles", *_LANES), "id"))

    signature = F.struct("id", "n_shingles", *_LANES)
    heads = posted.groupBy("key").agg(F.min(signature).alias("head"), F.count("*").alias("members")).where("members > 1")
    star = join_sized(posted.drop("at"), heads, ["key"], "members").select("head", signature.alias("member"))
    star = star.where(f"member.id > head.id AND {_near('member', 'head', percent)}").select(F.col("head.id").alias("a"), F.col("member.id").alias("b"))
    links = cut_lineage(confirm(cut_lineage(star.distinct()), texts, size, percent))
    grouped = components(links)

    label = F.coalesce("component_id", "id").alias("label")
    members = posted.join(grouped, "id", "left").select("at", "key", "id", "n_shingles", *_LANES, label)
    links = links.union(cut_lineage(rest_links(members, texts, size, percent)))
    grouped = components(links)

    named = classes.join(grouped, "id", "left").select(*whole, F.coalesce("component_id", "id").alias("component_id"))
    return signed.select("id", *whole).join(named, whole, "left").select(
        F.col("id").alias(id_column), "n_shingles", F.coalesce(F.when(F.col("id").isNotNull(), F.col("component_id")), "id").alias("component_id")
    )


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows with a number, from a table that doesn't change between its readers, and the name of that column, which the table had not."""
    name, spark = unused(docs.columns, "_row"), docs.sparkSession
    # Compressed columns: texts are most of the table, and its readers need different ones.
    path = f"{use_checkpoint_folder(spark).rstrip('/')}/numbered-{uuid.uuid4()}"
    docs.withColumn(name, F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path), name


def deduplicated(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", size: int = 3, percent: int = 85) -> DataFrame:
    """One row of each group of near-duplicates: the first by id (nulls last), then by row. Rows are told apart by number, so ids may be null or repeated.

    Rows without words (empty, null) are copies of nothing and all stay.
    """
    rows, number = numbered(docs)
    plain = rows.select(F.col(number).alias("row"), F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    found = near_duplicates(plain, "row", "text", size, percent)
    named = cut_lineage(found.select("row", "component_id").join(plain.select("row", "id"), "row"))
    first = named.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row"))["row"].alias("row"))
    # Few rows go, so they and not those that stay are looked up.
    gone = cut_lineage(named.select("row").join(first.select("row"), "row", "left_anti").withColumnRenamed("row", number))
    return without_ids(rows, gone, number).select(*docs.columns)
