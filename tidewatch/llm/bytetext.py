"""Words of whole Arrow text columns as numpy arrays, without a Python loop over words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words: all but ASCII white space.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False
#: Bytes of words after lower-casing: digits, a-z and everything beyond ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

#: Bytes of text whose words are hashed at once (a longer word is one block).
HASH_BYTES = 1 << 18

_TABLE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**64, size=256, dtype=U)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_MULTIPLIERS = np.random.Generator(np.random.PCG64(7)).integers(1, 2**64, size=64, dtype=U) | U(1)
_powers = np.ones(1, dtype=U), np.ones(1, dtype=U)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2**64."""
    global _powers
    if len(_powers[0]) < n:
        grown = []
        for base in (_BASE, _INVERSE):
            p = np.full(n, base, dtype=U)
            p[0] = 1
            grown.append(np.cumprod(p, dtype=U))
        if n > 1 << 23:  # one very long text: don't hold on to it
            return tuple(grown)
        _powers = tuple(grown)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def _length(n: int) -> np.uint64:
    return U(int(n) * 0x632BE59BD9B4E019 % 2**64)


class Words:
    """buf: bytes, lower-cased if ``lower``; start, end: byte places of words; doc: row of each word; first: where each row's words begin (rows + 1)."""

    def __init__(self, texts: pa.Array, is_word: np.ndarray = NOT_SPACE, lower: bool = True):
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        if texts.null_count:
            texts = texts.fill_null("")
        wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
        n = len(texts)
        _, off, data = texts.buffers()
        off = np.frombuffer(off, dtype=np.int64 if wide else np.int32, count=n + texts.offset + 1)[texts.offset :].astype(np.int64) if n else np.zeros(1, np.int64)
        lo, hi = int(off[0]), int(off[-1])
        raw = np.frombuffer(data, dtype=np.uint8, count=hi)[lo:] if hi > lo else np.zeros(0, np.uint8)
        self.offsets, self.rows = off - lo, n
        self.buf = LOWER[raw] if lower else raw
        w = is_word[self.buf]
        if len(w):
            before = np.empty_like(w)
            before[0], before[1:] = False, w[:-1]
            after = np.empty_like(w)
            after[-1], after[:-1] = False, w[1:]
            inner = self.offsets[1:-1]
            before[inner[inner < len(w)]] = False
            after[inner[inner > 0] - 1] = False
            self.start = np.flatnonzero(w & ~before)
            self.end = np.flatnonzero(w & ~after) + 1
        else:
            self.start = self.end = np.zeros(0, np.int64)
        self.first = np.searchsorted(self.start, self.offsets)
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(n), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word; words are taken in blocks of about HASH_BYTES, as sums and powers take 8 bytes a byte each."""
        out = np.zeros(len(self.start), dtype=U)
        i = 0
        while i < len(out):
            lo = int(self.start[i])
            j = max(i + 1, int(np.searchsorted(self.end, lo + HASH_BYTES, "right")))
            buf, start, end = self.buf[lo : self.end[j - 1]], self.start[i:j] - lo, self.end[i:j] - lo
            up, down = powers(len(buf) + 1)
            p = np.zeros(len(buf) + 1, dtype=U)
            np.cumsum(_TABLE[buf] * up[:-1], out=p[1:])
            out[i:j] = mix((p[end] - p[start]) * down[start] + (end - start).astype(U) * U(0xA24BAED4963EE407))
            i = j
        return out

    def text(self, i: int, j: int) -> bytes:
        """Words i to j - 1, joined by single blanks."""
        b = self.buf
        return b" ".join(b[s:e].tobytes() for s, e in zip(self.start[i:j], self.end[i:j]))


def strings(words: Words, at: np.ndarray) -> pa.Array:
    """The words with these indices, as an Arrow string array, gathered without a loop."""
    size = words.end[at] - words.start[at]
    off = np.zeros(len(at) + 1, dtype=np.int64)
    np.cumsum(size, out=off[1:])
    data = words.buf[np.repeat(words.start[at] - off[:-1], size) + np.arange(off[-1])]
    return pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(off), pa.py_buffer(data)).cast(pa.string())


def windows(words: Words, h: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words of a row, and the first word's index."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U), np.zeros(0, np.int64)
    ok = words.doc[:n] == words.doc[k - 1 :]
    acc = h[:n] * _MULTIPLIERS[0]
    for j in range(1, k):
        acc = acc + h[j : n + j] * _MULTIPLIERS[j % 64] * (U(2 * (j // 64)) + U(1))
    at = np.flatnonzero(ok)
    return mix(acc[at] + _length(k)), at


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """Sorted distinct k-word shingle hashes of each row; a row with fewer words has its whole sequence as one."""
    words = Words(texts)
    h = words.hashes()
    sh, at = windows(words, h, k)
    bounds = np.searchsorted(at, words.first)
    out = []
    for i in range(words.rows):
        n = words.counts[i]
        if n >= k:
            out.append(np.unique(sh[bounds[i] : bounds[i + 1]]))
        elif n:
            a = int(words.first[i])
            out.append(mix((h[a : a + n] * _MULTIPLIERS[:n]).sum(keepdims=True) + _length(n)))
        else:
            out.append(np.zeros(0, U))
    return out
