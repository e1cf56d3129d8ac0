"""Word kernels shared by the free-style operators of this subpackage.

A slab of texts is one buffer of bytes, in which words are parted by one space. Words are
numbered by comparing their bytes, so equal numbers are equal words, and shingles get
numbers from those of their parts, so equal numbers are equal shingles: within a slab
nothing rests on a hash. Hashes of words and grams, prefix sums of a polynomial modulo
2**64 whose base is odd and so has an inverse, only choose candidates. What is decided
across tasks without the texts at hand rests on cryptographic digests of 128 bits of the
words' bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa

# Odd constants of the polynomials and of the finaliser (fixed values).
BYTE_BASE = 0x9E3779B97F4A7C15
GRAM_BASE = 0xD1342543DE82EF95
MIX_1 = 0xFF51AFD7ED558CCD
MIX_2 = 0xC4CEB9FE1A85EC53

#: Bytes of text handled at once, besides one text that is longer.
SLAB_BYTES = 1 << 20
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept up to four slabs."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, SLAB_BYTES + 1)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 4 * SLAB_BYTES:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the whole word."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(MIX_1)
    x ^= x >> np.uint64(33)
    x *= np.uint64(MIX_2)
    x ^= x >> np.uint64(33)
    return x


def _slices(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    n = len(values)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values * powers(base, n), out=sums[1:])
    inverse = powers(pow(base, -1, 1 << 64), n + 1)
    return (sums[ends] - sums[starts]) * inverse[starts]


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive word hashes; empty if there are fewer than k."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    starts = np.arange(n)
    return mix(_slices(words, starts, starts + k, GRAM_BASE) + np.uint64(k))


def sliding_min(values: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values, by doubling."""
    n = len(values) - w + 1
    if n <= 0:
        return values[:0]
    have, span = values, 1
    while span * 2 <= w:
        have = np.minimum(have[:-span], have[span:])
        span *= 2
    return np.minimum(have[:n], have[w - span : w - span + n]) if span < w else have[:n]


def digest128(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def halves(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """128-bit digests as two columns of longs."""
    both = np.array([], "<i8") if not digests else np.frombuffer(b"".join(digests), "<i8")
    return both[0::2], both[1::2]


@dataclass
class Slab:
    """Some rows of a batch: row i has the words first[i]:first[i + 1], word j the bytes data[at[j] : at[j + 1] - 1]."""

    rows: np.ndarray
    data: np.ndarray
    at: np.ndarray
    first: np.ndarray

    @property
    def n_words(self) -> np.ndarray:
        return np.diff(self.first)

    @cached_property
    def hashes(self) -> np.ndarray:
        if len(self.at) == 1:
            return np.zeros(0, np.uint64)
        return mix(_slices(self.data.astype(np.uint64) + np.uint64(1), self.at[:-1], self.at[1:] - 1, BYTE_BASE))

    @cached_property
    def numbers(self) -> np.ndarray:
        """Equal if and only if the words' bytes are."""
        column = pa.Array.from_buffers(pa.large_binary(), len(self.at) - 1, [None, pa.py_buffer(self.at.astype(np.int64)), pa.py_buffer(self.data)])
        return column.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)

    def same_row(self, k: int) -> np.ndarray:
        """Of each k consecutive words: whether they lie in one row."""
        n = len(self.at) - k
        if n <= 0:
            return np.zeros(0, bool)
        return self.row_of(np.arange(n)) == self.row_of(np.arange(k - 1, n + k - 1))

    def row_of(self, words: np.ndarray) -> np.ndarray:
        """The place in rows of each word."""
        return np.repeat(np.arange(len(self.rows)), self.n_words)[words]

    def digests(self, start: np.ndarray, end: np.ndarray) -> list[bytes]:
        """Digests of the words start:end, parted by one space."""
        data = self.data.tobytes()
        return [digest128(data[a : max(a, b)]) for a, b in zip(self.at[start].tolist(), (self.at[end] - 1).tolist())]


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def bytes_of(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of a string column; a null has none."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def slab_of(texts: list[bytes], rows: np.ndarray | None = None, lower: bool = False) -> Slab:
    """The texts' words, parted at white space of ASCII."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    raw = np.frombuffer(b" ".join([*texts, b""]), np.uint8)  # a space behind each text
    if lower:
        raw = _LOWER[raw]
    inside = ~SPACE[raw]
    ends = inside[:-1] & ~inside[1:] if len(raw) else inside
    keep = inside.copy()
    keep[1:] |= ends  # of white space only the byte behind a word
    data = np.where(inside, raw, np.uint8(0x20))[keep]
    at = np.concatenate([[0], np.flatnonzero(data == 0x20) + 1])
    words = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(np.concatenate([ends, [False]]) if len(raw) else ends, out=words[1:])
    first = words[np.concatenate([[0], np.cumsum(sizes)])]
    return Slab(np.arange(len(texts)) if rows is None else rows, data, at, first)


def cuts(sizes: list[int], most: int = SLAB_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most so many bytes together, or of one row."""
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if total + size > most and i > start:
            yield start, i
            start, total = i, 0
        total += size
    if sizes:
        yield start, len(sizes)


def slabs(column: pa.Array, lower: bool = False) -> Iterator[Slab]:
    """Cuts a string column into slabs of whole rows."""
    texts = bytes_of(column)
    for a, b in cuts([len(t) for t in texts]):
        yield slab_of(texts[a:b], np.arange(a, b), lower)


def shingle_numbers(numbers: np.ndarray, k: int) -> np.ndarray:
    """A number for each k consecutive words of a slab: equal if and only if the words are."""
    have, span = numbers, 1
    while span < k:
        step = min(span, k - span)
        a, b = have[:-step], have[step:]
        if not len(a):
            return np.zeros(0, np.int64)
        have, span = a * (int(have.max()) + 1) + b, span + step
        if span < k:  # numbers small enough to be paired again
            have = np.unique(have, return_inverse=True)[1]
    return have
