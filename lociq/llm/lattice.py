"""Document likelihood by a lattice over all segmentations into subwords.

A word's probability is the sum, over all ways to cut it into pieces of an existing
vocabulary (single bytes always among them), of the product of the pieces'
probabilities: a forward recursion in log space, for many words of one length at
once, and strip by strip for a word too long for that, of which only the pieces that
occur in it and one number a byte are held. The vocabulary's own scores give the first weights; expectation-maximisation on the
training words refines them. A text is its words, each with a word mark in
front, and one end; its probability is their product.

Words are counted over all texts. The frequent ones (a share of the tokens bounds
their number) are sent to all tasks, the others are joined, and are too rare to be hot.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociq.llm.text import SPACED, buffer, lengths, mix, prefix_sums, slices, span_hashes, words_of
from lociq.session import cut_lineage

#: At most so many words are sent to all tasks: those with a share of the tokens of at least one in this number.
HEAD = 1 << 20
ROUNDS = 2
#: Weight of the vocabulary's own scores against the corpus, in pieces.
PRIOR = 1000.0
MARK = "▁".encode()
#: Distinct words, and their bytes, that a task gathers before it sends their counts.
GATHERED, GATHERED_BYTES = 400_000, 64 << 20
#: Places (byte, length of a piece) of the words of a block; a word with more goes by strips of so many bytes.
CELLS, STRIP = 1_000_000, 4096
SMOOTH = 0.1


class Pieces:
    """Pieces of a sentencepiece file: a number for the fingerprint of a byte string."""

    def __init__(self, model: str):
        from sentencepiece import SentencePieceProcessor

        loaded = SentencePieceProcessor(model_file=model)
        spelt: dict[bytes, float] = {}
        for k in range(loaded.get_piece_size()):
            if not (loaded.is_control(k) or loaded.is_unknown(k) or loaded.is_byte(k) or loaded.is_unused(k)):
                spelt[loaded.id_to_piece(k).encode()] = loaded.get_score(k)
        lowest = min(spelt.values(), default=-1.0, key=lambda s: s if s > -1e8 else 0.0)
        for b in range(256):
            spelt.setdefault(bytes([b]), lowest)
        names = sorted(spelt)
        codes, bounds = buffer(pa.array(names, pa.binary()))
        hashes = span_hashes(prefix_sums(codes), bounds[:-1], bounds[1:])
        order = np.argsort(hashes)
        self.count, self.longest = len(names), max(map(len, names))
        self.hashes = hashes[order]
        # Merge ranks (scores of -1, -2, ...) are weighted by Zipf's law; log probabilities are taken as they are.
        scores = np.array([spelt[names[k]] for k in order])
        self.prior = 1 / (1 + np.minimum(-scores, 1e9)) if lowest < -100 else np.exp(scores)
        bits = 18
        self.shift = np.uint64(64 - bits)
        self.bucket = np.searchsorted(self.hashes >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64))
        self.deepest = int(np.diff(self.bucket).max())

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each piece, or ``count``."""
        high = (hashes >> self.shift).astype(np.int64)
        at, end = self.bucket[high], self.bucket[high + 1]
        out = np.full(len(hashes), self.count, np.int64)
        for k in range(self.deepest):
            here = np.flatnonzero(at + k < end)
            hit = here[self.hashes[at[here] + k] == hashes[here]]
            out[hit] = at[hit] + k
        return out


def is_long(words: pa.Array, pieces: Pieces, cells: int) -> np.ndarray:
    """Whether a word has more places than a block may have."""
    n = lengths(words) + len(MARK)
    return n * np.minimum(n, pieces.longest) > cells


def lattices(words: pa.Array, pieces: Pieces, cells: int = CELLS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of words of one length: their rows, and the piece that ends at byte j + 1 and has k + 1 bytes, as (word, j, k). Without the long words."""
    short = np.flatnonzero(~is_long(words, pieces, cells))
    marked = pa.array([MARK + w for w in words.take(pa.array(short)).to_pylist()], pa.binary())
    codes, bounds = buffer(marked)
    sums = prefix_sums(codes)
    length = np.diff(bounds)
    order = np.argsort(length, kind="stable")
    cut = np.flatnonzero(np.diff(length[order], prepend=-1))
    for a, b in zip(cut, np.append(cut[1:], len(order))[: len(cut)], strict=True):
        n = int(length[order[a]])
        wide = min(n, pieces.longest)
        step = max(1, cells // (n * wide))
        for at in range(a, b, step):
            rows = order[at : min(at + step, b)]
            start = np.arange(n)[:, None] - np.arange(wide)[None, :]
            arcs = np.full((len(rows), n, wide), pieces.count, np.int64)
            ok = start >= 0
            begin = bounds[rows][:, None] + start[ok][None, :]
            end = bounds[rows][:, None] + (np.broadcast_to(np.arange(n)[:, None], start.shape)[ok] + 1)[None, :]
            arcs[:, ok] = pieces.find(span_hashes(sums, begin.ravel(), end.ravel())).reshape(len(rows), -1)
            yield short[rows], arcs


class LongWord:
    """The lattice of one word, made anew for each strip of end positions."""

    def __init__(self, word: bytes, pieces: Pieces, strip: int = STRIP):
        self.sums, self.pieces, self.strip = prefix_sums(np.frombuffer(MARK + word, np.uint8)), pieces, strip
        self.n = len(self.sums) - 1

    def strips(self) -> range:
        """Where the strips begin."""
        return range(0, self.n, self.strip)

    def arcs(self, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(begin, end, piece) of the pieces that end in the strip at ``at``, by end."""
        end = np.arange(at + 1, min(at + self.strip, self.n) + 1)[:, None]
        begin = end - 1 - np.arange(self.pieces.longest)
        inside = begin >= 0
        begin, end = begin[inside], np.broadcast_to(end, inside.shape)[inside]
        piece = self.pieces.find(span_hashes(self.sums, begin, end))
        some = piece < self.pieces.count
        return begin[some], end[some], piece[some]

    def walk(self, logs: np.ndarray, back: bool = False) -> np.ndarray:
        """Log weights of all prefixes, or ``back`` of all suffixes, by byte."""
        out = array("d", [-math.inf]) * (self.n + 1)
        out[self.n if back else 0] = 0.0
        exp, log1p, none = math.exp, math.log1p, -math.inf
        for at in reversed(self.strips()) if back else self.strips():
            begin, end, piece = self.arcs(at)
            # Backwards, all pieces that begin at a byte come before those that end there.
            come, go, cost = (x[::-1] if back else x for x in ((end if back else begin), (begin if back else end), logs[piece]))
            for i, j, w in zip(come.tolist(), go.tolist(), cost.tolist(), strict=True):
                low, high = out[i] + w, out[j]
                if low > high:
                    low, high = high, low
                if low > none:
                    high += log1p(exp(low - high))
                out[j] = high
        return np.frombuffer(out)


def long_words(words: pa.Array, pieces: Pieces, cells: int = CELLS) -> Iterator[tuple[int, LongWord]]:
    """The rows and lattices of the words that are too long for a block."""
    for row in np.flatnonzero(is_long(words, pieces, cells)).tolist():
        yield row, LongWord(words[row].as_py(), pieces)


def forward(arcs: np.ndarray, logs: np.ndarray) -> np.ndarray:
    """Log weights of all prefixes: (word, byte). ``logs`` has -inf for no piece."""
    many, n, wide = arcs.shape
    out = np.full((many, n + 1), -np.inf)
    out[:, 0] = 0.0
    for j in range(n):
        k = min(j + 1, wide)
        out[:, j + 1] = _sum(logs[arcs[:, j, :k]] + out[:, j - np.arange(k)])
    return out


def backward(arcs: np.ndarray, logs: np.ndarray) -> np.ndarray:
    """Log weights of all suffixes: (word, byte)."""
    many, n, wide = arcs.shape
    out = np.full((many, n + 1), -np.inf)
    out[:, n] = 0.0
    for i in range(n - 1, -1, -1):
        k = np.arange(min(n - i, wide))
        out[:, i] = _sum(logs[arcs[:, i + k, k]] + out[:, i + k + 1])
    return out


def _sum(x: np.ndarray) -> np.ndarray:
    top = x.max(axis=1)
    return top + np.log(np.exp(x - np.where(np.isfinite(top), top, 0.0)[:, None]).sum(axis=1))


def expected(words: pa.Array, weights: np.ndarray, pieces: Pieces, logs: np.ndarray, cells: int = CELLS) -> np.ndarray:
    """Expected number of each piece in all segmentations of the words."""
    out = np.zeros(pieces.count + 1)
    for rows, arcs in lattices(words, pieces, cells):
        left, right = forward(arcs, logs), backward(arcs, logs)
        many, n, wide = arcs.shape
        begin = np.maximum(np.arange(n)[:, None] - np.arange(wide)[None, :], 0)
        share = np.exp(left[:, begin] + logs[arcs] + right[:, 1:, None] - left[:, n][:, None, None]) * weights[rows][:, None, None]
        out += np.bincount(arcs.ravel(), share.ravel(), pieces.count + 1)
    for row, word in long_words(words, pieces, cells):
        left, right = word.walk(logs), word.walk(logs, back=True)
        for at in word.strips():
            begin, end, piece = word.arcs(at)
            out += np.bincount(piece, np.exp(left[begin] + logs[piece] + right[end] - left[-1]) * weights[row], pieces.count + 1)
    return out[:-1]


def log_probabilities(words: pa.Array, pieces: Pieces, logs: np.ndarray, cells: int = CELLS) -> np.ndarray:
    """log10 of each word's marginal probability."""
    out = np.zeros(len(words))
    for rows, arcs in lattices(words, pieces, cells):
        out[rows] = forward(arcs, logs)[:, -1] / np.log(10)
    for row, word in long_words(words, pieces, cells):
        out[row] = word.walk(logs)[-1] / np.log(10)
    return out


def word_counts(docs: DataFrame) -> DataFrame:
    """(hash, word, c, total): the training count and the count of each distinct word of (text, held_out)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for part in slices(batch, "text"):
                words = words_of(part.column("text"), SPACED)
                if not len(words.hash):
                    continue
                train = ~np.asarray(part.column("held_out").to_numpy(zero_copy_only=False), bool)[words.row()]
                key, first, of = np.unique(words.hash, return_index=True, return_inverse=True)
                raw = words.codes.tobytes()
                spelt = np.array([raw[s:e] for s, e in zip(words.start[first].tolist(), words.end[first].tolist(), strict=True)], object)
                held.append((key, spelt, np.bincount(of, train, len(key)).astype(np.int64), np.bincount(of, minlength=len(key))))
                size += sum(map(len, spelt))
                if sum(len(h[0]) for h in held) > GATHERED or size > GATHERED_BYTES:
                    held = [_merged(held)]
                    size = sum(map(len, held[0][1]))
                    if len(held[0][0]) > GATHERED // 2 or size > GATHERED_BYTES // 2:
                        yield _counts(held.pop())
                        size = 0
        if held:
            yield _counts(_merged(held))

    made = docs.mapInArrow(run, "hash long, word binary, c long, total long")
    return made.groupBy("hash", "word").agg(F.sum("c").alias("c"), F.sum("total").alias("total"))


def _merged(held: list[tuple]) -> tuple:
    key, first, of = np.unique(np.concatenate([h[0] for h in held]), return_index=True, return_inverse=True)
    return key, np.concatenate([h[1] for h in held])[first], *(np.bincount(of, np.concatenate([h[k] for h in held]), len(key)).astype(np.int64) for k in (2, 3))


def _counts(held: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(held[0].view(np.int64)), pa.array(held[1].tolist(), pa.binary()), pa.array(held[2]), pa.array(held[3])], names=["hash", "word", "c", "total"])


def learn(counts: DataFrame, ends: int, model: str, rounds: int = ROUNDS) -> np.ndarray:
    """Natural log probabilities of the pieces, then of the end (and -inf for no piece), from the training words."""
    pieces = Pieces(model)
    weights = PRIOR * pieces.prior / pieces.prior.sum()
    ends = ends + 1.0
    sent = counts.sparkSession.sparkContext.broadcast
    logs = None
    for step in range(rounds + 1):
        logs = np.concatenate([np.log(weights) - np.log(weights.sum() + ends), [-np.inf]])
        if step == rounds:
            break
        given = sent(logs)

        def run(batches: Iterator[pa.RecordBatch], given=given) -> Iterator[pa.RecordBatch]:
            pieces, out = Pieces(model), 0.0
            for batch in batches:
                for part in slices(batch, "word", 1 << 20):
                    out = out + expected(part.column("word"), part.column("c").to_numpy(), pieces, given.value)
            if isinstance(out, np.ndarray):
                some = np.flatnonzero(out)
                yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(out[some])], names=["piece", "n"])

        # One row for each piece of the vocabulary, whatever the corpus.
        told = counts.where("c > 0").select("word", "c").mapInArrow(run, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).toPandas()
        weights = PRIOR * pieces.prior / pieces.prior.sum()
        weights[told["piece"].to_numpy(np.int64)] += told["n"].to_numpy()
    return np.concatenate([logs, [np.log(ends) - np.log(weights.sum() + ends)]])


def lattice_scores(docs: DataFrame, model: str, id_column: str = "doc_id", text_column: str = "text", rounds: int = ROUNDS, head: int = HEAD) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) per row.

    Learns from rows whose crc32 of the id as text is not 0 modulo 10 (a null id
    counts as an empty text, so it is held out). Words are lower-cased (A-Z) runs
    without white space; an empty or null text is one end. ``score`` is the log10 of the lattice
    probability of the words and the end, ``base_score`` that of smoothed word
    counts. A word may be of any length: memory grows by a few numbers for each of its bytes. Without any training rows the vocabulary's own scores and empty counts are used. Repeated rows count and are scored each.
    """
    spark = docs.sparkSession
    key = F.coalesce(F.col(id_column).cast("string"), F.lit(""))
    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"), (F.crc32(key.cast("binary")) % 10 == 0).alias("held_out"))
    counts = cut_lineage(word_counts(rows))
    total = counts.agg(F.sum("c").alias("n"), F.sum("total").alias("all"), F.sum((F.col("c") > 0).cast("long")).alias("v")).first()
    ends = rows.where("NOT held_out").count()
    n, distinct = (total["n"] or 0) + ends, (total["v"] or 0) + (ends > 0)
    logs = learn(counts, ends, model, rounds)
    below = np.log10(n + SMOOTH * (distinct + 1))
    sent = spark.sparkContext.broadcast(logs)

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(model)
        for batch in batches:
            for part in slices(batch, "word", 1 << 20):
                c = part.column("c").to_numpy()
                arrays = [part.column("hash"), part.column("total"), pa.array(c > 0), pa.array(np.log10(c + SMOOTH) - below), pa.array(log_probabilities(part.column("word"), pieces, sent.value[:-1]))]
                yield pa.RecordBatch.from_arrays(arrays, names=["hash", "total", "known", "base", "own"])

    scored = cut_lineage(counts.mapInArrow(spell, "hash long, total long, known boolean, base double, own double"))
    least = -(-(total["all"] or 0) // head)  # so many tokens at least: no more than ``head`` words have them
    frequent = scored.where(F.col("total") >= least).select("hash", "known", "base", "own").toArrow().combine_chunks()
    order = np.argsort(frequent.column("hash").to_numpy().view(np.uint64))
    table = spark.sparkContext.broadcast([np.ascontiguousarray(x[order]) for x in (frequent.column("hash").to_numpy().view(np.uint64), frequent.column("known").to_numpy(), frequent.column("base").to_numpy(), frequent.column("own").to_numpy())])
    of_end = (ends > 0, float(np.log10(ends + SMOOTH) - below), float(logs[-1] / np.log(10)))
    fields = f"row long, id {kind}, held_out boolean, n_tokens long, known long, base double, own double, word long, times long"

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each text with the sums over frequent words, and one for each other word of a text."""
        hashes, known, base, own = table.value
        for batch in batches:
            for part in slices(batch, "text"):
                words = words_of(part.column("text"), SPACED)
                row, many = words.row(), part.num_rows
                at = np.minimum(np.searchsorted(hashes, words.hash), max(len(hashes) - 1, 0))
                found = hashes[at] == words.hash if len(hashes) else np.zeros(len(at), bool)
                total = [np.bincount(row[found], x[at[found]], many) for x in (known, base, own)]
                rare, times = np.unique(np.stack([row[~found].astype(np.uint64), words.hash[~found]], 1), axis=0, return_counts=True)
                owner, pad = rare[:, 0].astype(np.int64), np.zeros(len(rare))
                # The rows of texts have a key of their own, so that they don't meet in one partition.
                key = np.concatenate([mix(np.asarray(part.column("row"), np.uint64)), rare[:, 1]]).view(np.int64)
                absent = np.arange(many + len(rare)) >= many
                take = pa.array(np.concatenate([np.arange(many), owner]))
                only = pa.array(np.concatenate([np.arange(many), owner]), mask=absent)
                yield pa.RecordBatch.from_arrays(
                    [part.column("row").take(take), part.column("id").take(only), part.column("held_out").take(only), pa.array(np.concatenate([np.diff(words.first) + 1, pad]).astype(np.int64)), pa.array(np.concatenate([total[0] + of_end[0], pad]).astype(np.int64))]
                    + [pa.array(np.concatenate([total[k] + of_end[k], pad])) for k in (1, 2)] + [pa.array(key), pa.array(np.concatenate([np.zeros(many, np.int64), times]))],
                    names=["row", "id", "held_out", "n_tokens", "known", "base", "own", "word", "times"],
                )

    told = rows.withColumn("row", F.monotonically_increasing_id()).mapInArrow(sums, fields)
    rare = scored.where(F.col("total") < least).select(F.col("hash").alias("word"), F.col("known").alias("w_known"), F.col("base").alias("w_base"), F.col("own").alias("w_own"))
    each = lambda mine, theirs: F.sum(F.col(mine) + F.coalesce(F.col("times") * F.col(theirs), F.lit(0)))
    summed = told.join(rare.withColumn("w_known", F.col("w_known").cast("long")), "word", "left").groupBy("row").agg(
        F.max("id").alias(id_column), F.max("held_out").alias("held_out"), F.sum("n_tokens").alias("n_tokens"), each("known", "w_known").alias("n_known"), each("base", "w_base").alias("base_score"), each("own", "w_own").alias("score")
    )
    return summed.select(id_column, "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
