"""Words and hashes of words over Arrow text columns, vectorised with numpy.

A word hash is a polynomial over a table of random 64-bit values for bytes,
modulo 2**64; a window hash is one over mixed word hashes. Prefix sums give
the hash of any range in constant time, so the cost is a few passes over the
bytes whatever the window length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are worked on in runs of about this many bytes; a longer text is a run of its own.
RUN_BYTES = 1 << 20

BASE = 0x9E3779B97F4A7C17
_M64 = (1 << 64) - 1


def byte_class(*ranges: tuple[int, int], inside: bool = True) -> np.ndarray:
    """bool[256]: bytes in any of the inclusive ranges (or outside all, if not inside)."""
    t = np.zeros(256, bool)
    for a, b in ranges:
        t[a : b + 1] = True
    return t if inside else ~t


#: [^\x20\x09-\x0D]
NOT_SPACE = byte_class((0x20, 0x20), (0x09, 0x0D), inside=False)
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]
ALNUM_OR_HIGH = byte_class((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F), inside=False)
KEEP_CASE = np.arange(256, dtype=np.uint8)
LOWER_ASCII = KEEP_CASE.copy()
LOWER_ASCII[0x41:0x5B] += 0x20

_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _Powers:
    """B**i and B**-i modulo 2**64 for i below a length that grows on demand."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def forget(self, beyond: int) -> None:
        """Drop tables that a text longer than usual made large."""
        if len(self.up) > beyond:
            self.up, self.down = self.up[:1].copy(), self.down[:1].copy()

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(self.base, k, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(self.inverse, k, 1 << 64))])
        return self.up[:n], self.down[:n]


_byte_powers, _word_powers = _Powers(BASE), _Powers(0xD1342543DE82EF97)


def forget() -> None:
    for powers in (_byte_powers, _word_powers):
        powers.forget(4 * RUN_BYTES)


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (splitmix64 finaliser)."""
    h = h + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & _M64)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass
class Run:
    """Words of consecutive texts. Offsets are into buf; first[d] .. first[d + 1] are the words of text d."""

    rows: slice
    buf: np.ndarray
    text_at: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def hashes(self) -> np.ndarray:
        """A mixed 64-bit hash for each word."""
        up, down = _byte_powers(len(self.buf) + 1)
        sums = np.zeros(len(self.buf) + 1, np.uint64)
        np.cumsum(_BYTE[self.buf] * up[:-1], out=sums[1:])
        return mix((sums[self.end] - sums[self.start]) * down[self.start] + (self.end - self.start).astype(np.uint64))

    def word(self, i: int) -> bytes:
        return self.buf[self.start[i] : self.end[i]].tobytes()


def window_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """The hash of each range of size consecutive word hashes (len(h) - size + 1 values; none if fewer words)."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = _word_powers(len(h) + 1)
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[:-1], out=sums[1:])
    return mix((sums[size:] - sums[:-size]) * down[:n], size)


def range_hashes(h: np.ndarray, start: np.ndarray, end: np.ndarray, salt: int = 0) -> np.ndarray:
    """The hash of each given range of word hashes; a range's length is part of it."""
    up, down = _word_powers(len(h) + 1)
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(mix(h, salt) * up[:-1], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64), salt)


def text_column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """The column as strings without nulls (null: empty)."""
    col = batch.column(batch.schema.get_field_index(name))
    return pc.fill_null(col.cast(pa.string()), "") if col.null_count or not pa.types.is_string(col.type) else col


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string array."""
    if len(col) == 0 or col.buffers()[2] is None:
        return np.zeros(len(col) + 1, np.int64), np.zeros(0, np.uint8)
    at = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    return at, np.frombuffer(col.buffers()[2], np.uint8)


def runs(col: pa.Array, is_word: np.ndarray, fold: np.ndarray = KEEP_CASE, run_bytes: int = RUN_BYTES) -> Iterator[Run]:
    """The words of each text, in runs of whole texts."""
    at, data = buffers(col)
    n, i = len(at) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + run_bytes, "right")) - 1)
        buf = data[at[i] : at[j]]
        if fold is not KEEP_CASE:
            buf = fold[buf]
        text_at = at[i : j + 1] - at[i]
        inside = is_word[buf]
        size = len(buf)
        edge = np.zeros(size + 1, bool)
        edge[text_at] = True
        before = np.empty(size, bool)
        before[:1] = False
        before[1:] = inside[:-1]
        start = np.flatnonzero(inside & ~(before & ~edge[:-1]))
        after = np.empty(size, bool)
        after[-1:] = False
        after[:-1] = inside[1:]
        end = np.flatnonzero(inside & ~(after & ~edge[1:])) + 1
        yield Run(slice(i, j), buf, text_at, start, end, np.searchsorted(start, text_at))
        i = j
