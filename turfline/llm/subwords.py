"""Subword ids of whole texts by a public tokenizer, one white-space chunk at a time.

The word tokenizer drops white space before it splits a text, so the ids of a text are the
ids of its chunks in order. A slice of texts is cut and hashed as one array; each distinct
chunk is looked up once and its ids are gathered for all its places. Chunks also end where a
mark follows an ASCII letter, as the tokenizer splits there in any case, and ASCII capitals
count as small ones; both are left alone where a special token could be ("<"). Chunks of Latin letters
go straight to the library's merge model in the byte alphabet that it uses; every other
chunk takes the library's whole path. What a worker has met it keeps, up to ``KEPT`` chunks.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa

from turfline.llm.common import LOWER, ragged, span_hashes, text_slices, word_bounds

KEPT = 800_000
LATIN_END = 0x250
_LETTER, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[97:123] = _MARK[33:48] = _MARK[58:65] = _MARK[91:97] = _MARK[123:127] = True


def byte_alphabet() -> list[str]:
    """Character for each byte in byte-level vocabularies: printable Latin-1 characters stand
    for themselves, the other bytes for the characters from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class ChunkIds:
    """Ids of chunks, held in one pool; entry 0 is the end of a text."""

    def __init__(self, path: str, end_id: int):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.alphabet, self.end_id = self.tokenizer.model, dict(enumerate(byte_alphabet())), end_id
        self.forget()

    def forget(self) -> None:
        self.table: dict[int, int] = {}
        self.pool, self.used = np.full(1 << 20, self.end_id, np.uint16), 1
        self.starts, self.sizes, self.count = np.zeros(1 << 18, np.int64), np.ones(1 << 18, np.int64), 1

    def fresh(self, chunk: bytes) -> list[int]:
        if chunk.isalpha():
            return [t.id for t in self.model.tokenize(chunk.decode().lower())]
        text = chunk.decode("utf-8", "replace")
        if text.isalpha() and max(text) < chr(LATIN_END) and unicodedata.is_normalized("NFC", text):
            low = text.lower()
            if len(low) == len(text):
                low = low.encode().decode("latin-1").translate(self.alphabet)
                return [t.id for t in self.model.tokenize(low)]
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def add(self, keys: list[int], chunks: list[bytes]) -> None:
        """Take in new chunks; the arrays double when they are full."""
        found = [self.fresh(c) for c in chunks]
        sizes = np.array([len(f) for f in found], np.int64)
        flat = np.array([i for f in found for i in f], np.uint16)
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while self.count + len(found) > len(self.starts):
            self.starts, self.sizes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.sizes))
        self.pool[self.used : self.used + len(flat)] = flat
        own = slice(self.count, self.count + len(found))
        self.starts[own], self.sizes[own] = self.used + np.cumsum(sizes) - sizes, sizes
        self.table.update(zip(keys, range(self.count, self.count + len(found)), strict=True))
        self.used, self.count = self.used + len(flat), self.count + len(found)

    def entries(self, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Entry of each distinct chunk."""
        if self.count > KEPT:
            self.forget()
        keys, get = hashes.tolist(), self.table.get
        found = [get(k, -1) for k in keys]
        new = [i for i, f in enumerate(found) if f < 0]
        if new:
            first = self.count
            self.add([keys[i] for i in new], [data[starts[i] : ends[i]].tobytes() for i in new])
            for n, i in enumerate(new):
                found[i] = first + n
        return np.array(found, np.int64)

    def encode(self, texts: pa.Array) -> pa.Array:
        """Little-endian 16-bit ids of every text, the end id last, as binary values."""
        parts, lengths = [], [np.zeros(0, np.int64)]
        for first, end, data, offsets in text_slices(texts):
            if not (data == ord("<")).any():
                data = LOWER[data]
                cuts = np.zeros(len(data) + 1, bool)
                cuts[1:-1] = _LETTER[data[:-1]] & _MARK[data[1:]]
                starts, ends, rows = word_bounds(data, offsets, cuts)
            else:
                starts, ends, rows = word_bounds(data, offsets)
            hashes, at, back = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
            entry = self.entries(hashes, data, starts[at], ends[at])[back] if len(hashes) else np.zeros(0, np.int64)
            stops = np.cumsum(np.bincount(rows, minlength=end - first))
            entry = np.insert(entry, stops, 0)
            sizes = self.sizes[entry]
            parts.append(self.pool[ragged(self.starts[entry], sizes)])
            upto = np.cumsum(sizes)[stops + np.arange(end - first)]
            lengths.append(np.diff(upto, prepend=0))
        flat = np.concatenate([*parts, np.zeros(0, np.uint16)]).astype("<u2")
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(lengths)) * 2])
        buffers = [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(flat)]
        return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, buffers)


_LOADED: dict[tuple[str, int], ChunkIds] = {}


def chunk_ids(path: str, end_id: int) -> ChunkIds:
    """The worker's table for a tokenizer file."""
    if (path, end_id) not in _LOADED:
        _LOADED[path, end_id] = ChunkIds(path, end_id)
    return _LOADED[path, end_id]


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
