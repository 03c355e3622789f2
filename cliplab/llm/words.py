"""Words, shingles and their hashes for whole Arrow batches of texts, in numpy.

A word is a run of bytes other than 0x20 and 0x09-0x0D.  These bytes never occur inside a
multi-byte UTF-8 character, so the work is done on the batch's byte buffer without making a
Python string per word.  Hashes are polynomial in randomised bytes, modulo 2**64, and mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
CHUNK_BYTES = 1 << 21
_BYTE_BASE = np.uint64(0x9E3779B97F4A7C15)
_WORD_BASE = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned 64-bit integers (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _byte_table(fold_case: bool) -> np.ndarray:
    codes = np.arange(256, dtype=np.uint64)
    if fold_case:
        codes[65:91] += np.uint64(32)
    return mix((codes + np.uint64(1)) * _BYTE_BASE)


_TABLES = {fold: _byte_table(fold) for fold in (False, True)}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """1, base, base**2, ... modulo 2**64."""
    out = np.full(max(n, 1), base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a batch and the n + 1 offsets of its texts; a null is an empty text."""
    column = column.cast(pa.large_string()) if column.type != pa.large_string() else column
    column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data, offsets


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `limit` bytes together; a longer text stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


class Words:
    """Words of a run of texts: byte spans, hashes, and where each text's words begin."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, fold_case: bool = False):
        base = int(offsets[0])
        self.data = data[base : int(offsets[-1])]
        self.offsets = offsets - base
        inside = ~SPACE[self.data]
        begins, finishes = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        finishes[:-1] &= ~inside[1:]
        if len(inside):
            heads = self.offsets[:-1][np.diff(self.offsets) > 0]
            begins[heads] = inside[heads]
            tails = self.offsets[1:][np.diff(self.offsets) > 0] - 1
            finishes[tails] = inside[tails]
        self.starts = np.flatnonzero(begins)
        self.ends = np.flatnonzero(finishes) + 1
        self.first = np.searchsorted(self.starts, self.offsets)
        self.hashes = self._hash(_TABLES[fold_case])

    def _hash(self, table: np.ndarray) -> np.ndarray:
        sizes = self.ends - self.starts
        out = np.empty(len(sizes), dtype=np.uint64)
        if not len(sizes):
            return out
        power = powers(_BYTE_BASE, int(sizes.max()))
        filled = np.concatenate(([0], np.cumsum(sizes)))
        for i, j in chunks(filled):
            at = filled[i:j] - filled[i]
            within = np.arange(filled[j] - filled[i]) - np.repeat(at, sizes[i:j])
            where = within + np.repeat(self.starts[i:j], sizes[i:j])
            out[i:j] = np.add.reduceat(table[self.data[where]] * power[within], at)
        return mix(out + sizes.astype(np.uint64))

    def windows(self, n: int, base: np.uint64 = _WORD_BASE) -> np.ndarray:
        """Rolling (Rabin-Karp) hash of n words from every word on; see `complete` for its validity."""
        w = self.hashes
        out = np.zeros(len(w), dtype=np.uint64)
        if len(w) >= n:
            power = powers(base, len(w))
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(w * power, dtype=np.uint64)))
            inverse = np.uint64(pow(int(base), -1, 1 << 64))
            m = len(w) - n + 1
            out[:m] = (sums[n:] - sums[:-n]) * powers(inverse, m)
        return mix(out)

    def complete(self, n: int) -> np.ndarray:
        """True at words from which n words of the same text follow."""
        last = np.repeat(self.first[1:], np.diff(self.first))
        return np.arange(len(self.hashes)) + n <= last

    def shingles(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of n-word shingles text after text, and the offsets of the texts.

        A text of fewer words (at least one) has its whole sequence as one shingle.
        """
        values, keep = self.windows(n), self.complete(n)
        counts = np.diff(self.first)
        short = np.flatnonzero((counts > 0) & (counts < n))
        for d in short:
            i, j = self.first[d], self.first[d + 1]
            whole = np.sum(self.hashes[i:j] * powers(_WORD_BASE, j - i), dtype=np.uint64)
            salted = (int(whole) + int(j - i) * 0x5851F42D4C957F2D) % 2**64
            values[i] = mix(np.array([salted], dtype=np.uint64))[0]
            keep[i] = True
        sizes = np.where(counts >= n, counts - n + 1, (counts > 0).astype(np.int64))
        return values[keep], np.concatenate(([0], np.cumsum(sizes)))


def word_chunks(column: pa.Array, fold_case: bool = False) -> Iterator[tuple[int, int, Words]]:
    """(i, j, Words of texts i..j) for a batch, in pieces of bounded size."""
    data, offsets = text_buffers(column)
    for i, j in chunks(offsets):
        yield i, j, Words(data, offsets[i : j + 1], fold_case)


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)
