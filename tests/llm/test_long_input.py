"""Words of any length, the whole score of a lattice against a plain one, and large benchmarks."""

import itertools
import math
import random
import time
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from lociq.llm import chain, lattice, wu_manber

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def letters(seed, n):
    return bytes(random.Random(seed).choices(b"etaoinshrdlu", k=n))


@pytest.mark.parametrize("strip", [1, 7, 4096])
def test_long_words_have_the_weights_of_short_ones(strip, monkeypatch):
    monkeypatch.setattr(lattice.LongWord.__init__, "__defaults__", (strip,))
    pieces = lattice.Pieces(PIECES)
    logs = np.concatenate([np.log(pieces.prior / pieces.prior.sum()), [-np.inf]])
    words = pa.array([letters(k, n) for k, n in enumerate([1, 5, 60, 200, 200, 333])] + ["日本語".encode() * 30, b"\xff\x00" * 9], pa.binary())
    weights = np.arange(1.0, len(words) + 1)
    # The same words as blocks, as strips, and some of them each way.
    for cells in (1, 3000):
        assert np.allclose(lattice.log_probabilities(words, pieces, logs, cells), lattice.log_probabilities(words, pieces, logs), rtol=1e-12)
        assert np.allclose(lattice.expected(words, weights, pieces, logs, cells), lattice.expected(words, weights, pieces, logs), rtol=1e-9)


def test_memory_of_a_long_word():
    pieces = lattice.Pieces(PIECES)
    logs = np.concatenate([np.log(pieces.prior / pieces.prior.sum()), [-np.inf]])
    word = pa.array([letters(1, 300_000)], pa.binary())
    lattice.prefix_sums(np.zeros(1, np.uint8))  # the tables of powers are made once in a worker
    tracemalloc.start()
    assert np.isfinite(lattice.log_probabilities(word, pieces, logs)).all()
    assert lattice.expected(word, np.ones(1), pieces, logs).sum() > 300_000 / pieces.longest
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6


def test_gathered_words_are_bounded_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(lattice, "GATHERED_BYTES", 1000)
    texts = [(" ".join(letters(k * 9 + j, 300).decode() for j in range(9)), k % 2 == 0) for k in range(20)] + [("aa bb aa", False)]
    found = {bytes(r.word): (r.c, r.total) for r in lattice.word_counts(spark.createDataFrame(texts, "text string, held_out boolean").coalesce(1)).collect()}
    assert len(found) == 182 and found[b"aa"] == (2, 2) and found[letters(0, 300)] == (0, 1) and found[letters(9, 300)] == (1, 1)


def test_whole_score_against_all_segmentations(spark):
    texts = {k: " ".join(random.Random(k).choices(["the", "hers", "é", "ot", "thot", "s"], k=6)) for k in range(30)} | {30: None, 31: "new the"}
    pieces = lattice.Pieces(PIECES)
    number = lambda b: int(pieces.find(lattice.span_hashes(lattice.prefix_sums(np.frombuffer(b, np.uint8)), np.array([0]), np.array([len(b)])))[0])

    def ways(word):
        """The pieces of every segmentation."""
        b = lattice.MARK + word.encode()
        for cuts in itertools.product([0, 1], repeat=len(b) - 1):
            at = [0, *(k + 1 for k, c in enumerate(cuts) if c), len(b)]
            found = [number(b[i:j]) for i, j in itertools.pairwise(at)]
            if pieces.count not in found:
                yield found

    of = {w: list(ways(w)) for t in texts.values() for w in (t or "").split()}
    train = [t or "" for k, t in texts.items() if zlib.crc32(str(k).encode()) % 10]
    ends = len(train) + 1.0
    start = lattice.PRIOR * pieces.prior / pieces.prior.sum()
    weights = start
    for _ in range(2):
        p = weights / (weights.sum() + ends)
        weights = start.copy()
        for word in (w for t in train for w in t.split()):
            each = [math.prod(p[k] for k in way) for way in of[word]]
            for way, share in zip(of[word], each, strict=True):
                np.add.at(weights, way, share / sum(each))
    p, end = weights / (weights.sum() + ends), math.log10(ends / (weights.sum() + ends))
    want = {k: end + sum(math.log10(sum(math.prod(p[i] for i in way) for way in of[w])) for w in (t or "").split()) for k, t in texts.items()}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    for head in (1 << 20, 3):
        found = {r.doc_id: r.score for r in lattice.lattice_scores(docs, PIECES, rounds=2, head=head).collect()}
        assert found.keys() == want.keys() and all(abs(found[k] - want[k]) < 1e-9 for k in want)


def test_large_benchmarks_compile_in_bounded_time_and_memory():
    rng = random.Random(5)
    vocabulary = [letters(k, 1 + k % 9).decode() for k in range(5000)]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.choice([3, 40, 400])))) for k in range(4000)]
    items += [(4000 + k, items[k][1]) for k in range(500)]
    tracemalloc.start()
    began = time.time()
    searches = wu_manber.compile_strings(items)
    took, size = time.time() - began, sum(len(t) for _, t in items)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert took < 30 and peak < 60 * size + 50e6
    long = next(k for k in range(500) if len(items[k][1].split()) == 400)
    text = "before " + " ".join(items[long][1].split()[5:40]) + " after " + items[7][1]
    _, hits = wu_manber.find(pa.array([text, None, ""]), searches)
    assert {i for h in hits for i in h[3]} >= {long, 4000 + long, 7, 4007} and all(h[0] == 0 for h in hits)
    for row, first, many, numbers in hits:
        window = " ".join(text.split()[first : first + many])
        assert numbers == [n for n, t in items if f" {window} " in f" {t} " and (many == 13 or len(t.split()) == many)]


def test_later_links_read_earlier_ones():
    """The last category is told by the first alone: without the link before it, its words are too weak."""
    rng = np.random.default_rng(3)
    rows, truth = 600, rng.random(600) < 0.4
    signs = [(r, c) for r in range(rows) for c in range(30) if rng.random() < (0.5 if truth[r] else 0.2)]
    x = chain.Sparse(np.array([r for r, _ in signs], np.int32), np.array([c for _, c in signs], np.int32), np.ones(len(signs), np.float32), rows, 30, np.zeros((rows, 0)))
    labels = np.column_stack([truth, truth]).astype(float)
    links = chain.fit_chain(x, labels, np.arange(rows) % chain.FOLDS)
    # One more weight for the link before, and a positive one; scoring feeds it that probability.
    assert len(links[1]) == len(links[0]) + 1
    p = chain.chain_probabilities(x, links)
    without = [links[0], np.where(np.arange(len(links[1])) == 30, 0.0, links[1])]
    changed = chain.chain_probabilities(x, without)
    assert np.allclose(p[:, 0], changed[:, 0]) and np.abs(p[:, 1] - changed[:, 1]).max() > 0.05
    assert ((p[:, 1] >= 0.5) == truth).mean() > 0.85
