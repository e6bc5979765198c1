"""Vectorised text primitives shared by the corpus operators (NumPy over Arrow batches).

A *block* is the concatenated UTF-8 of a bounded number of whole documents.  Words are the
maximal runs of bytes outside ``0x20, 0x09-0x0D``; a document is never cut, so a block is as
large as ``BLOCK_BYTES`` or one document, whichever is more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 19

_rng = np.random.default_rng(0x5EED)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LANES = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_pows: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that sums and differences become uniform."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64."""
    if len(_pows[0]) < n:
        size = max(n, BLOCK_BYTES + (1 << 16))
        for k, base in enumerate((_BASE, _INV)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _pows[k] = np.multiply.accumulate(p)
    return _pows[0], _pows[1]


def span_hash(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Position-independent 64-bit hash of each byte span ``buf[start:end]``."""
    pw, inv = powers(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[buf] * pw[: len(buf)], out=sums[1:])
    size = (end - start).astype(np.uint64)
    return mix((sums[end] - sums[start]) * inv[start] + size * _LANES[63])


class Block:
    """Whole documents: ``buf`` bytes, ``off`` document offsets, word starts, ends and document index."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, lower: bool = False):
        self.buf = LOWER[buf] if lower else buf
        self.off = off
        self.n = len(off) - 1
        word = ~SPACE[self.buf]
        edge = np.zeros(len(buf) + 1, bool)
        edge[off] = True
        begin = word.copy()
        begin[1:] &= ~word[:-1] | edge[1:-1]
        stop = word.copy()
        stop[:-1] &= ~word[1:] | edge[1:-1]
        self.ws = np.flatnonzero(begin)
        self.we = np.flatnonzero(stop) + 1
        self.first = np.searchsorted(self.ws, off)  # words of document d: first[d]..first[d+1]
        self._hash: np.ndarray | None = None

    @property
    def words(self) -> np.ndarray:
        """64-bit hash of every word."""
        if self._hash is None:
            self._hash = span_hash(self.buf, self.ws, self.we)
        return self._hash

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), np.diff(self.first))

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of every k-word window inside one document, with the index of its first word."""
        w = self.words
        if len(w) < k:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        h = w[: len(w) - k + 1] * _LANES[0]
        for j in range(1, k):
            h = h + w[j : len(w) - k + 1 + j] * _LANES[j]
        doc = self.doc_of_word()
        ok = np.flatnonzero(doc[: len(h)] == doc[k - 1 :])
        return mix(h[ok]), ok

    def sequence_hash(self, d: int) -> np.ndarray:
        """One hash of the whole word sequence of a short document."""
        w = self.words[self.first[d] : self.first[d + 1]]
        return mix((w * _LANES[: len(w)] + _LANES[62]).sum(dtype=np.uint64, keepdims=True))

    def shingle_sets(self, k: int = 5) -> list[np.ndarray]:
        """Sorted distinct k-word shingle hashes per document; fewer words: the whole sequence; none: empty."""
        h, at = self.windows(k)
        cut = np.searchsorted(at, self.first)
        out = []
        for d in range(self.n):
            words = self.first[d + 1] - self.first[d]
            if words >= k:
                s = np.sort(h[cut[d] : cut[d + 1]])
                out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
            else:
                out.append(self.sequence_hash(d) if words else np.zeros(0, np.uint64))
        return out


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string column, nulls as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, off


def blocks(batch: pa.RecordBatch, column: str = "text", lower: bool = False, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, Block]]:
    """(first row, end row, block) pieces of a batch, each of about ``limit`` bytes or one document."""
    raw, off = text_buffers(batch.column(batch.schema.get_field_index(column)))
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        j = min(j, n)
        yield i, j, Block(raw[off[i] : off[j]], off[i : j + 1] - off[i], lower)
        i = j


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
