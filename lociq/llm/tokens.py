"""Token ids of whole texts by a public tokenizer file, a word at a time.

``word_bpe_49k.json`` drops white space and no token crosses it, so the ids of a
text are those of its words (runs without ASCII white space) in order. Each
worker process encodes a word once and keeps its ids in a bounded table. ASCII
letters are lower-cased first, as the tokenizer does, which makes more words equal;
not in texts with a combining mark or ``<|``, where case could matter to the
normaliser or to a special string.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array

import numpy as np
import pyarrow as pa

from lociq.llm.text import SPACED, buffer, words_of

#: Words that one worker process keeps, then it begins anew.
KEPT = 500_000

# Words of these characters are whole already, and Python's lower case is the tokenizer's.
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]*")
# How the tokenizer of words divides them (a fixed value), for plain words.
_DIVIDE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
# How byte-level tokenizers spell bytes (a fixed rule): printable ones as they are, the rest from 256 on.
_printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
_SPELL = {b: chr(b) for b in _printable} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in _printable)}

_loaded: dict[str, Encoder] = {}


def digest_of(path: str) -> str:
    """Version digest of a tokenizer: its file and the library that runs it."""
    import tokenizers

    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + tokenizers.__version__.encode()).hexdigest()


class Known:
    """Ids of words by fingerprint: an open-addressing table of numbers and one flat array of ids."""

    def __init__(self, room: int) -> None:
        slots = 1 << (2 * room).bit_length()
        self.mask, self.room = np.uint64(slots - 1), room
        self.keys, self.at = np.zeros(slots, np.uint64), np.zeros(slots, np.int32)
        self.ids, self.first, self.count = np.zeros(1 << 16, "<u4"), np.zeros(room + 1, np.int64), 0

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each word, or -1."""
        slot = hashes & self.mask
        at = np.where((found := self.keys[slot]) == hashes, self.at[slot], -1)
        going = np.flatnonzero((found != hashes) & (found != 0))
        while len(going):
            slot[going] = (slot[going] + np.uint64(1)) & self.mask
            found = self.keys[slot[going]]
            hit = found == hashes[going]
            at[going[hit]] = self.at[slot[going[hit]]]
            going = going[~hit & (found != 0)]
        return at

    def add(self, hashes: list[int], ids: list[bytes]) -> None:
        """Store words that ``find`` doesn't know."""
        mask, keys, at = int(self.mask), self.keys, self.at
        for n, key in enumerate(hashes, self.count):
            slot = key & mask
            while keys[slot]:
                slot = (slot + 1) & mask
            keys[slot], at[slot] = key, n
        flat, ends = np.frombuffer(b"".join(ids), "<u4"), np.cumsum([len(x) // 4 for x in ids])
        used = self.first[self.count]
        while used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[used : used + len(flat)] = flat
        self.first[self.count + 1 : self.count + 1 + len(ids)] = used + ends
        self.count += len(ids)


class Encoder:
    """Ids of texts. ``words=False`` encodes each text in one piece, for tokenizers whose tokens cross white space."""

    def __init__(self, path: str, words: bool = True):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer, self.words, self.known, self.parts = Tokenizer.from_file(path), words, Known(KEPT), {}

    def whole(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text, by the whole tokenizer."""
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def learn(self, words: list[bytes]) -> list[bytes]:
        """Ids of words not met before. Plain ones go straight to the model, part by part; others through the whole tokenizer."""
        tokenize, parts, out, odd = self.tokenizer.model.tokenize, self.parts, [], []
        if len(parts) > KEPT // 2:
            parts.clear()
        for n, word in enumerate(words):
            text = word.decode()
            if "<|" in text or not _PLAIN.fullmatch(text):
                odd.append(n)
                out.append(b"")
                continue
            ids = b""
            for part in _DIVIDE.findall(text.lower()):
                known = parts.get(part)
                if known is None:
                    spelt = part if part.isascii() else "".join(map(_SPELL.__getitem__, part.encode()))
                    known = parts[part] = array("I", [t.id for t in tokenize(spelt)]).tobytes()
                ids += known
            out.append(ids)
        for n, ids in zip(odd, self.whole([words[n].decode() for n in odd]), strict=True):
            out[n] = ids
        return out

    def column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a column, one after the other, and where each text's begin (one more at the end); null is empty."""
        if not self.words:
            ids = self.whole([t.as_py() or "" for t in texts])
            return np.frombuffer(b"".join(ids), "<u4"), np.cumsum([0, *(len(x) // 4 for x in ids)])
        raw, bounds = buffer(texts)
        # Rows where letter case might matter keep it.
        odd = np.flatnonzero((raw == 0xCC) | (raw == 0xCD) | ((raw == ord("<")) & (np.roll(raw, -1) == ord("|"))))
        words = words_of(texts, SPACED, np.unique(np.searchsorted(bounds, odd, "right") - 1))
        at = self.known.find(words.hash)
        if (at < 0).any():
            if self.known.count + int((at < 0).sum()) > self.known.room:
                self.known = Known(max(KEPT, len(at)))
                at[:] = -1
            new = np.flatnonzero(at < 0)
            hashes, one = np.unique(words.hash[new], return_index=True)
            codes = words.codes.tobytes()
            spelt = [codes[s:e] for s, e in zip(words.start[new[one]].tolist(), words.end[new[one]].tolist(), strict=True)]
            self.known.add(hashes.tolist(), self.learn(spelt))
            at = self.known.find(words.hash)
        n = self.known.first[at + 1] - self.known.first[at]
        ends = np.concatenate([[0], np.cumsum(n)])
        ids = self.known.ids[np.repeat(self.known.first[at] - ends[:-1], n) + np.arange(ends[-1])]
        return ids, ends[words.first]


def encoder(path: str, words: bool = True) -> Encoder:
    """The encoder of this worker process for a tokenizer file."""
    key = f"{path}|{words}"
    if key not in _loaded:
        _loaded[key] = Encoder(path, words)
    return _loaded[key]
