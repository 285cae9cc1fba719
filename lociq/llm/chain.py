"""Toxicity by a classifier chain.

Categories are predicted one after the other by linear models over the distinct
words of a text and their beginnings; each later model also sees the probabilities of the earlier
categories. In training those are out-of-fold predictions, so a later model learns from
what it will meet. The chain is fitted in one task on a bounded sample of labelled rows
and the model, bounded by the words of that sample, is sent to all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociq.llm.text import ALNUM, mix, prefix_sums, release, slices, span_hashes, words_of

#: Labelled rows that a chain is fitted on at most (those with the smallest hash of their id).
MAX_LABELLED = 8_000
#: Labelled texts that a feature has to be in.
MIN_TEXTS = 4
#: Features that a chain uses at most, and the z score each must have.
MAX_FEATURES, MIN_Z = 4096, 5.0
#: Bytes of the word beginnings that are features too, for words that inflection or compounding makes rare.
BEGINNINGS = (4, 5, 6, 7, 8)
FOLDS, STEPS, RATE, PENALTY = 3, 200, 0.1, 2e-5


@dataclass
class Sparse:
    """Rows of features with values, as triples, and the dense columns of each row."""

    row: np.ndarray
    col: np.ndarray
    value: np.ndarray
    rows: int
    cols: int
    dense: np.ndarray

    def times(self, w: np.ndarray) -> np.ndarray:
        n = self.cols
        return np.bincount(self.row, w[self.col] * self.value, self.rows) + self.dense @ w[n:-1] + w[-1]

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bincount(self.col, r[self.row] * self.value, self.cols), self.dense.T @ r, [r.sum()]])

    def pick(self, chosen: np.ndarray) -> Sparse:
        place, keep = np.cumsum(chosen) - 1, chosen[self.row]
        return Sparse(place[self.row[keep]], self.col[keep], self.value[keep], int(chosen.sum()), self.cols, self.dense[chosen])

    def beside(self, column: np.ndarray) -> Sparse:
        return Sparse(self.row, self.col, self.value, self.rows, self.cols, np.column_stack([self.dense, column]))


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature) of the distinct words of each text and of their beginnings, and the number of distinct words of each text."""
    words = words_of(column, ALNUM)
    row = words.row()
    order = np.lexsort((words.hash, row))
    new = np.ones(len(order), bool)
    new[1:] = (words.hash[order[1:]] != words.hash[order[:-1]]) | (row[order[1:]] != row[order[:-1]])
    one = order[new]
    row, start, end = row[one], words.start[one], words.end[one]
    sums = prefix_sums(words.codes)
    rows, found = [row], [words.hash[one]]
    for size in BEGINNINGS:
        longer = np.flatnonzero(end - start > size)
        rows.append(row[longer])
        found.append(mix(span_hashes(sums, start[longer], start[longer] + size) + np.uint64(size)))
    return np.concatenate(rows), np.concatenate(found), np.bincount(row, minlength=len(column))


def matrix(column: pa.Array, known: np.ndarray) -> Sparse:
    """The features of each text that are among the sorted ones ``known``: log counts, and the log of the distinct words."""
    row, found, many = features(column)
    width = max(len(known), 1)
    at = np.minimum(np.searchsorted(known, found), width - 1)
    hit = known[at] == found if len(known) else np.zeros(len(at), bool)
    pairs, times = np.unique(row[hit] * width + at[hit], return_counts=True)
    return Sparse(pairs // width, pairs % width, np.log1p(times), len(column), len(known), np.log1p(many)[:, None])


def select(seen: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> np.ndarray:
    """The features most unevenly spread over a category (z score), at most ``MAX_FEATURES``, sorted; ``seen``: (row, feature) of each slice.

    Features are counted a sixteenth at a time, by their high bits, which bounds the memory.
    """
    n, chosen, best = len(labels), [np.zeros(0, np.uint64)], [np.zeros(0)]
    for shard in range(16):
        inside = [found >> np.uint64(60) == shard for _, found in seen]
        row = np.concatenate([np.zeros(0, np.int64), *(r[i] for (r, _), i in zip(seen, inside, strict=True))])
        names, of = np.unique(np.concatenate([np.zeros(0, np.uint64), *(f[i] for (_, f), i in zip(seen, inside, strict=True))]), return_inverse=True)
        pairs = np.unique(of * np.int64(max(n, 1)) + row)
        of, row = pairs // max(n, 1), pairs % max(n, 1)
        texts = np.bincount(of, minlength=len(names))
        score = np.zeros(len(names))
        for y in labels.T.astype(float):
            p = y.sum()
            if 0 < p < n:
                hits = np.bincount(of, y[row], len(names))
                share = texts / n
                z = np.abs(hits / p - (texts - hits) / (n - p)) / np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / p + 1 / (n - p)))
                score = np.maximum(score, np.where((texts >= MIN_TEXTS) & (texts < n), z, 0))
        chosen.append(names[score >= MIN_Z])
        best.append(score[score >= MIN_Z])
    names, score = np.concatenate(chosen), np.concatenate(best)
    return np.sort(names[np.argsort(-score, kind="stable")[:MAX_FEATURES]])


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(x: Sparse, y: np.ndarray) -> np.ndarray:
    """Weights of the features, of the dense columns, and the constant: logistic loss with a square penalty, by Adam over all rows."""
    many = x.cols + x.dense.shape[1]
    w, m, v = np.zeros(many + 1), np.zeros(many + 1), np.zeros(many + 1)
    rate = np.clip(y.mean(), 1e-3, 1 - 1e-3) if len(y) else 0.5
    w[-1] = np.log(rate / (1 - rate))
    for step in range(1, STEPS + 1):
        g = x.back((sigmoid(x.times(w)) - y) / max(len(y), 1))
        g[:-1] += PENALTY * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return w


def fit_chain(x: Sparse, labels: np.ndarray, fold: np.ndarray) -> list[np.ndarray]:
    """One weight vector for each column of ``labels``, in order."""
    out = []
    for k in range(labels.shape[1]):
        y = labels[:, k].astype(float)
        out.append(fit(x, y))
        if k + 1 < labels.shape[1]:
            held = np.zeros(x.rows)
            for f in range(FOLDS):
                test = fold == f
                held[test] = sigmoid(x.pick(test).times(fit(x.pick(~test), y[~test])))
            x = x.beside(held)
    return out


def chain_probabilities(x: Sparse, chain: list[np.ndarray]) -> np.ndarray:
    """Probabilities (row, category), each category with those before it."""
    out = np.zeros((x.rows, 0))
    for w in chain:
        p = sigmoid(x.times(w))
        out, x = np.column_stack([out, p]), x.beside(p)
    return out


def learn_chain(sample: DataFrame, categories: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
    """(words, chain) from the rows (id, text, categories as 0/1) of a bounded sample, by one task."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("id").combine_chunks()
        text = table.column("text").chunk(0) if table.num_rows else pa.array([], pa.string())
        batch = pa.RecordBatch.from_arrays([text], names=["text"])
        labels = np.column_stack([table.column(c).to_numpy() for c in categories])
        seen, done = [], 0
        for part in slices(batch, "text"):
            row, found, _ = features(part.column("text"))
            seen.append(((row + done).astype(np.int32), found))
            done += part.num_rows
        words = select(seen, labels)
        seen.clear()
        parts = [matrix(part.column("text"), words) for part in slices(batch, "text")]
        before = np.cumsum([0, *(x.rows for x in parts)])
        x = Sparse(np.concatenate([x.row + n for x, n in zip(parts, before[:-1], strict=True)]), *(np.concatenate([getattr(x, c) for x in parts]) for c in ("col", "value")), done, len(words), np.concatenate([x.dense for x in parts]))
        chain = fit_chain(x, labels, np.arange(done) % FOLDS)
        return pa.table({"words": pa.array([words.tobytes()], pa.binary()), "chain": pa.array([[w.tobytes() for w in chain]], pa.list_(pa.binary()))})

    made = sample.select(F.lit(1).alias("one"), "id", "text", *categories).groupBy("one").applyInArrow(run, "words binary, chain array<binary>").first()
    if made is None:  # nothing is labelled: nothing is toxic
        return np.zeros(0, np.uint64), [np.concatenate([np.zeros(k + 1), [-40.0]]) for k in range(len(categories))]
    return np.frombuffer(made["words"], np.uint64), [np.frombuffer(w, np.float64) for w in made["chain"]]


def toxicity(docs: DataFrame, labels: DataFrame, categories: dict[str, str], id_column: str = "doc_id", text_column: str = "text", limit: int = MAX_LABELLED, prefix: str = "p_") -> DataFrame:
    """``docs`` with a probability ``p_<category>`` (or another ``prefix``) for each category, in the chain's order; columns of these names are replaced.

    ``categories``: name and SQL condition over the label table, from which the chain
    learns; rows whose condition or id is null are not learned from, and of
    labels repeated for one id the largest counts. A null or empty text gets the
    probability of a text without words. Repeated rows and null ids come through as they are.
    """
    names = list(categories)
    new = [f"{prefix}{n}" for n in names]
    docs = docs.select(*[c for c in docs.columns if c.lower() not in {n.lower() for n in new}])
    marks = labels.where(F.col(id_column).isNotNull()).groupBy(F.col(id_column).alias("id")).agg(*[F.max(F.expr(f"cast({sql} AS int)")).alias(n) for n, sql in categories.items()]).dropna(subset=names)
    texts = docs.where(F.col(id_column).isNotNull() & F.col(text_column).isNotNull()).select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    # The ids are drawn first, so that only the texts of the sample move.
    drawn = texts.select("id").join(marks, "id").dropDuplicates(["id"]).orderBy(F.xxhash64("id"), "id").limit(limit)
    words, chain = learn_chain(texts.join(F.broadcast(drawn), "id").dropDuplicates(["id"]), names)
    sent = docs.sparkSession.sparkContext.broadcast((words, chain))
    added = pa.schema([(n, pa.float64()) for n in new])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, chain = sent.value
        for batch in batches:
            for part in slices(batch, text_column):
                p = chain_probabilities(matrix(part.column(text_column), words), chain)
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(p[:, k].copy()) for k in range(len(names)))], names=[*part.schema.names, *added.names])
            release()

    kinds = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), *(f"`{n}` double" for n in added.names)])
    return docs.mapInArrow(run, kinds)
