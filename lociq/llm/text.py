"""Words and 64-bit fingerprints of whole Arrow text columns, with numpy inside a task.

Texts are cut into slices of rows of about ``SLICE`` bytes, so memory does not
depend on the rows of an Arrow batch; a longer text is a slice of its own.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 2_000_000
_BASE = 0x9E3779B97F4A7C55
INVERSE = pow(_BASE, -1, 1 << 64)

_codes = np.arange(256)
#: Bytes of words ``[^\x20\x09-\x0D]+``.
SPACED = ~((_codes == 0x20) | ((_codes >= 0x09) & (_codes <= 0x0D)))
#: Bytes of words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of lower-cased text.
ALNUM = ((_codes >= 0x30) & (_codes <= 0x39)) | ((_codes >= 0x61) & (_codes <= 0x7A)) | (_codes >= 0x80)
#: Lower-cases A-Z only.
LOWER = np.where((_codes >= 0x41) & (_codes <= 0x5A), _codes + 32, _codes).astype(np.uint8)


def unused(taken: Iterable[str], name: str) -> str:
    """A column name that is not taken, in any case: ``name`` with underscores behind it."""
    taken = {t.lower() for t in taken}
    while name.lower() in taken:
        name += "_"
    return name


def release() -> None:
    """Hand free memory of a worker back: workers live on for the next stage, and what they keep adds up on an executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter the bits of unsigned 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers = {_BASE: np.ones(1, np.uint64), INVERSE: np.ones(1, np.uint64)}


def powers(n: int, base: int = _BASE) -> np.ndarray:
    """The first ``n`` powers of ``base`` modulo 2**64."""
    if len(_powers[base]) < n:
        # Kept by the worker for good, so not longer than twice what was asked for.
        steps = np.full(1 << (n - 1).bit_length(), base, np.uint64)
        steps[0] = 1
        _powers[base] = np.cumprod(steps, dtype=np.uint64)
    return _powers[base][:n]


def prefix_sums(codes: np.ndarray) -> np.ndarray:
    """Sums of ``(code + 1) * base**position`` before each position."""
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * powers(len(codes)), out=out[1:])
    return out


def span_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Fingerprints of the spans ``[start, end)``, equal wherever the bytes are equal."""
    return mix((sums[end] - sums[start]) * powers(len(sums), INVERSE)[start] + (end - start).astype(np.uint64))


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about ``limit`` bytes in a text column."""
    ends = np.cumsum(lengths(batch.column(column)) + 64)
    first = 0
    while first < batch.num_rows:
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield batch.slice(first, last - first)
        first = last


def buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column without gaps, and where each row begins (one more at the end); null is empty."""
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    codes = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return codes, offsets - offsets[0]


def lengths(column: pa.Array) -> np.ndarray:
    """Bytes of each row; null has none."""
    return np.asarray(pc.binary_length(column).fill_null(0), np.int64) if len(column) else np.zeros(0, np.int64)


@dataclass
class Words:
    """All words of a column in order. ``first[d]``: the first word of row d, with one more at the end."""

    codes: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    def row(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def words_of(column: pa.Array, table: np.ndarray, as_is: Iterable[int] = ()) -> Words:
    """Words of lower-cased (A-Z only) texts: maximal runs of the bytes in ``table``, never across rows. Rows ``as_is`` keep their case."""
    raw, bounds = buffer(column)
    codes = LOWER[raw]
    for row in as_is:
        codes[bounds[row] : bounds[row + 1]] = raw[bounds[row] : bounds[row + 1]]
    inside = table[codes]
    edge = np.zeros(len(codes) + 1, bool)
    edge[bounds] = True
    opens = inside.copy()
    opens[1:] &= ~inside[:-1] | edge[1:-1]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:] | edge[1:-1]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return Words(codes, start, end, span_hashes(prefix_sums(codes), start, end), np.searchsorted(start, bounds))


def windows(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all runs of ``size`` words within a row, and the word each begins with."""
    n = len(words.hash)
    if n < size:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = words.hash[: n - size + 1].copy()
    for k in range(1, size):
        out = out * np.uint64(_BASE) + words.hash[k : n - size + 1 + k]
    row = words.row()
    at = np.flatnonzero(row[: n - size + 1] == row[size - 1 :])
    return mix(out[at]), at
