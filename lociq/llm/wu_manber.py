"""Benchmark decontamination by Wu-Manber search for runs of words.

Test strings are the 13-word windows of the benchmark items (a shorter item is one
string). Strings of one length are searched together: a table over blocks of two
words says how far the search may jump, a bucket by the hash of a string's last words
and then the hash of all its words select what to compare, and the words themselves are compared.
All texts of a slice are searched side by side, each from its own place, in numpy.

Benchmarks are cut into parts of bounded size; each part is sent to all tasks and
the documents are read once for each part. A string is the place of its first word in the
part, so the tables take some hundred bytes a word, and a worker makes them once for all its tasks.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociq.llm.text import ALNUM, Words, mix, release, slices, words_of
from lociq.session import cut_lineage

WINDOW = 13
#: Bytes of benchmark text that one search takes; more items are searched in further parts.
PART_BYTES = 8 << 20
_BITS = 20
#: Words that one pointer walks; longer texts have several, overlapping by a string less one word.
_LANE = 4096


class Search:
    """Tables of all test strings of one length (in words) among the words of a part: ``at`` their first words, ``number`` their items."""

    def __init__(self, words: Words, raw: bytes, length: int, at: np.ndarray, number: np.ndarray):
        self.words, self.raw, self.length = words, raw, length
        self.block = min(2, length)
        last = length - self.block
        # Equal strings are one, with all their items.
        self.whole, first, of = np.unique(self.hashes(words.hash, at), return_index=True, return_inverse=True)
        self.at = at[first]
        again = np.ones(len(at), bool)
        again[first] = False
        for place, same in zip(at[again].tolist(), of[again].tolist(), strict=True):
            if spelt(words, raw, place, length) != self.string(same):
                raise ValueError("two test strings have one fingerprint")
        order = np.argsort(of, kind="stable")
        self.number, self.owner = number[order], np.searchsorted(of[order], np.arange(len(first) + 1))
        self.shift = np.full(1 << _BITS, last + 1, np.int64)
        for k in range(last + 1):  # later blocks allow less
            self.shift[self.slot(words.hash, self.at + k)] = last - k
        self.known = np.unique(self.suffix(words.hash, self.at + last))

    def string(self, n: int) -> bytes:
        """A test string."""
        return spelt(self.words, self.raw, int(self.at[n]), self.length)

    def items(self, n: int) -> list[int]:
        """The items of a test string."""
        return sorted(set(self.number[self.owner[n] : self.owner[n + 1]].tolist()))

    def hashes(self, codes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Hash of the words of a string at each place."""
        key = np.full(len(at), self.length, np.uint64)
        for k in range(self.length):
            key = mix(key) + codes[at + k]
        return mix(key)

    def suffix(self, codes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Hash of the block of words at each place."""
        key = codes[at]
        for k in range(1, self.block):
            key = mix(key) + codes[at + k]
        return key

    def slot(self, codes: np.ndarray, at: np.ndarray) -> np.ndarray:
        return (mix(self.suffix(codes, at)) >> np.uint64(64 - _BITS)).astype(np.int64)

    def candidates(self, codes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Words at which a string may begin: where its last block is that of some string."""
        last = self.length - self.block
        lanes = [(a, min(a + _LANE, end - self.length + 1)) for start, end in zip(first[:-1].tolist(), first[1:].tolist(), strict=True) for a in range(start, end - self.length + 1, _LANE)]
        if not lanes:
            return np.zeros(0, np.int64)
        at, stop = np.array(lanes, np.int64).T.copy()
        out = []
        while len(at):
            shift = self.shift[self.slot(codes, at + last)]
            here = at[shift == 0]
            if len(here):
                key = self.suffix(codes, here + last)
                near = np.minimum(np.searchsorted(self.known, key), len(self.known) - 1)
                out.append(here[self.known[near] == key])
            at = at + np.maximum(shift, 1)
            going = at < stop
            at, stop = at[going], stop[going]
        return np.sort(np.concatenate(out)) if out else np.zeros(0, np.int64)


def spelt(words: Words, raw: bytes, at: int, many: int) -> bytes:
    """Some words from a place on, with a space between them."""
    return b" ".join(raw[s:e] for s, e in zip(words.start[at : at + many].tolist(), words.end[at : at + many].tolist(), strict=True))


def compile_strings(items: list[tuple[int, str | None]], size: int = WINDOW) -> list[Search]:
    """Search tables of (item number, text), by length. Items without words have no strings."""
    words = words_of(pa.array([t for _, t in items], pa.string()), ALNUM)
    raw, numbers, count = words.codes.tobytes(), np.array([n for n, _ in items], np.int64), np.diff(words.first)
    length, out = np.minimum(count, size), []
    for n in np.unique(length[length > 0]).tolist():
        mine = np.flatnonzero(length == n)
        many = count[mine] - n + 1
        before = np.cumsum(many) - many
        at = np.repeat(words.first[mine] - before, many) + np.arange(many.sum())
        out.append(Search(words, raw, n, at, np.repeat(numbers[mine], many)))
    return out


#: The tables a worker made last, and the name of their part.
_latest: list[tuple[str, list[Search]]] = []


def compiled(name: str, items: list[tuple[int, str]], size: int) -> list[Search]:
    """Search tables of a part, made once in a worker; those of the part before are let go first."""
    if not _latest or _latest[0][0] != name:
        _latest.clear()
        _latest.append((name, compile_strings(items, size)))
    return _latest[0][1]


def find(column: pa.Array, searches: list[Search]) -> tuple[np.ndarray, list[tuple[int, int, int, list[int]]]]:
    """Words of each row, and (row, first word, words, item numbers) of each occurrence, words counted from the row's first."""
    words = words_of(column, ALNUM)
    raw, found = None, []
    for search in searches:
        at = search.candidates(words.hash, words.first)
        whole = search.hashes(words.hash, at)
        near = np.minimum(np.searchsorted(search.whole, whole), len(search.whole) - 1)
        same = search.whole[near] == whole
        for place, n in zip(at[same].tolist(), near[same].tolist(), strict=True):
            raw = words.codes.tobytes() if raw is None else raw
            if spelt(words, raw, place, search.length) == search.string(n):
                row = int(np.searchsorted(words.first, place, "right") - 1)
                found.append((row, place - int(words.first[row]), search.length, search.items(n)))
    return np.diff(words.first), found


def parts_of(benchmark: DataFrame, limit: int = PART_BYTES) -> Iterator[list[tuple[int, str]]]:
    """The benchmark's (item_id, text), read in parts of at most ``limit`` bytes (or one item); at least one part."""
    part, size = [], 0
    for item, text in benchmark.orderBy("item_id").toLocalIterator():
        size += len(text.encode())
        if size > limit and part:
            yield part
            part, size = [], len(text.encode())
        part.append((item, text))
    yield part


def occurrences(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", size: int = WINDOW, limit: int = PART_BYTES, carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, n_words, spans, items) per row: hit word runs (first, words) sorted and merged, and the sorted item ids that occur.

    Words are lower-cased (A-Z) letters, digits and non-ASCII characters. Rows
    with a null or empty text have no words; the id may be null or repeated. Long columns in ``carry`` come along. Items with a null item_id or text count for nothing.
    """
    spans = "array<struct<first: long, words: long>>"
    kind = docs.schema[id_column].dataType.simpleString()
    kept = [f"carried{k}" for k in range(len(carry))]
    schema = f"row long, id {kind}, n_words long, spans {spans}, items array<long>" + "".join(f", {c} long" for c in kept)
    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"), *(F.col(c).alias(k) for c, k in zip(carry, kept, strict=True)))
    items = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "text")
    several = items.agg(F.sum(F.octet_length("text")) > limit).first()[0]
    # A row's number joins the parts; it is made from a table that doesn't change between them.
    texts = cut_lineage(texts.withColumn("row", F.monotonically_increasing_id())) if several else texts.withColumn("row", F.lit(0).cast("long"))
    found = None
    for part in parts_of(items, limit):
        sent, name = docs.sparkSession.sparkContext.broadcast(part), str(uuid.uuid4())

        def run(batches: Iterator[pa.RecordBatch], sent=sent, name=name) -> Iterator[pa.RecordBatch]:
            searches = compiled(name, sent.value, size)
            for batch in batches:
                for part in slices(batch, "text"):
                    n, hits = find(part.column("text"), searches)
                    runs, seen = defaultdict(list), defaultdict(set)
                    for row, first, length, numbers in hits:
                        runs[row].append((first, first + length))
                        seen[row].update(numbers)
                    some = range(part.num_rows)
                    yield pa.RecordBatch.from_arrays(
                        [part.column("row"), part.column("id"), pa.array(n), pa.array([[{"first": a, "words": b - a} for a, b in merged(runs[r])] if r in runs else [] for r in some], pa.list_(pa.struct([("first", pa.int64()), ("words", pa.int64())]))), pa.array([sorted(seen[r]) if r in seen else [] for r in some], pa.list_(pa.int64())), *(part.column(c) for c in kept)],
                        names=["row", "id", "n_words", "spans", "items", *kept],
                    )
                release()

        now = texts.mapInArrow(run, schema)
        found = now if found is None else found.unionByName(now)
    if several:
        found = found.groupBy("row", "id", "n_words", *kept).agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        found = found.withColumn("spans", _merge("spans"))
    return found.select(F.col("id").alias(id_column), "n_words", "spans", "items", *(F.col(k).alias(c) for c, k in zip(carry, kept, strict=True)))


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted runs (first, end) without overlaps; runs that touch become one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _merge(column: str):
    """``merged`` for a column of (first, words)."""
    step = """(done, s) -> CASE WHEN size(done) > 0 AND s.first <= element_at(done, -1).first + element_at(done, -1).words
        THEN concat(slice(done, 1, size(done) - 1), array(named_struct('first', element_at(done, -1).first, 'words', greatest(element_at(done, -1).words, s.first + s.words - element_at(done, -1).first))))
        ELSE concat(done, array(s)) END"""
    return F.expr(f"aggregate(array_sort({column}), cast(array() AS array<struct<first: bigint, words: bigint>>), {step})")


def contamination(found: DataFrame, id_column: str = "doc_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, *carry, n_words, n_hit, n_items, items_sha256, contaminated) of ``occurrences``: 5 % of the words or more are hit."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["words"])
    digest = F.sha2(F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ","), 256)
    return found.select(id_column, *carry, "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256")).withColumn(
        "contaminated", F.expr("n_hit > 0 AND 20 * n_hit >= n_words")
    )
