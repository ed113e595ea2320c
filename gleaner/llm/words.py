"""Words, lines and hashes of many texts at once: numpy over the bytes of a batch, without a loop over texts or words."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa

#: Letters in lower case, and other ASCII characters as spaces; bytes of other characters stay.
FOLD = bytes(ord(chr(c).lower()) if c < 128 and chr(c).isalnum() else c if c >= 128 else 32 for c in range(256))
#: A-Z in lower case and ASCII white space (0x20 and 0x09 to 0x0D) as spaces; other bytes stay.
SPACED = bytes(c + 32 if 65 <= c <= 90 else 32 if 9 <= c <= 13 else c for c in range(256))
BASE = 0x9E3779B97F4A7C15


def mixed(h: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers in which every bit depends on all."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(31))


def _ranges(inside: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values, none of which goes over a bound."""
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    at = bounds[1:-1][(bounds[1:-1] > 0) & (bounds[1:-1] < len(inside))]
    first[at], last[at - 1] = inside[at], inside[at - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


class Chunk:
    """Consecutive texts: their bytes, where each begins, and the words of all of them: what ``table`` does not make a space.

    ``start`` and ``end`` are the bytes of each word, ``bounds[i]`` is the first word of text i and ``doc`` the text of each word.
    """

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, table: bytes = FOLD):
        self.raw, self.offsets = raw, offsets
        self._folded = np.frombuffer(table, np.uint8)[raw]
        self.start, self.end = _ranges(self._folded != 32, offsets)
        self.bounds = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.bounds)

    @cached_property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)

    @cached_property
    def hash(self) -> np.ndarray:
        """A 64-bit hash of each folded word, eight bytes at a time; other words of up to eight bytes never share one."""
        padded = np.concatenate([self._folded, np.zeros(8, np.uint8)])
        eight = np.ndarray((len(self._folded) + 1,), "<u8", padded, strides=(1,))
        length = self.end - self.start
        out = length.astype(np.uint64)
        some, at = slice(None), 0
        while len(out[some]):
            cut = np.uint64(8) * np.maximum(8 - (length[some] - at), 0).astype(np.uint64)
            block = (eight[self.start[some] + at] << cut) >> cut
            out[some] = mixed(out[some] * np.uint64(BASE) + block + np.uint64(at))
            at += 8
            some = np.flatnonzero(length > at)
        return out

    @cached_property
    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """First and past-the-last byte of every line that is not empty."""
        return _ranges(self.raw != 10, self.offsets)

    @cached_property
    def lines_before(self) -> np.ndarray:
        """For each text the lines of all earlier ones."""
        return np.searchsorted(self.lines[0], self.offsets)

    @cached_property
    def chars(self) -> np.ndarray:
        """Characters before each byte, from the start of the chunk."""
        return np.concatenate([np.zeros(1, np.int64), np.cumsum((self.raw & 0xC0) != 0x80, dtype=np.int64)])


def chunks(column: pa.Array, most: int = 1 << 20, table: bytes = FOLD) -> Iterator[tuple[int, int, Chunk]]:
    """Rows low to high of a text column and their chunk: of about ``most`` bytes, or one text that is longer. A null is an empty text."""
    data = column.cast(pa.binary())
    if data.null_count:
        data = data.fill_null(b"")
    _, ends, raw = data.buffers()
    at = np.frombuffer(ends, np.int32)[data.offset : data.offset + len(data) + 1].astype(np.int64) if len(data) else np.zeros(1, np.int64)
    every = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    low = 0
    while low < len(data):
        high = max(low + 1, int(np.searchsorted(at, at[low] + most, "right")) - 1)
        yield low, high, Chunk(every[at[low] : at[high]], at[low : high + 1] - at[low], table)
        low = high


class Grams:
    """Hashes of all runs of some number of words, from sums of word hashes times powers of an odd number."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            n = 1 << n.bit_length()
            steps = lambda x: np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, x, np.uint64)]), dtype=np.uint64)
            self.up, self.down = steps(BASE), steps(pow(BASE, -1, 1 << 64))

    def sums(self, words: np.ndarray) -> np.ndarray:
        self._powers(len(words) + 1)
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * self.up[: len(words)], dtype=np.uint64)])

    def hashes(self, sums: np.ndarray, size: int) -> np.ndarray:
        """Of every run of ``size`` words."""
        return mixed((sums[size:] - sums[:-size]) * self.down[: len(sums) - size])

    def between(self, sums: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Of the words from low to high, with their number."""
        return mixed((sums[high] - sums[low]) * self.down[low] + mixed((high - low).astype(np.uint64)))


def least(h: np.ndarray, size: int) -> np.ndarray:
    """The minimum of each run of ``size`` values."""
    have = 1
    while 2 * have <= size:
        h, have = np.minimum(h[:-have], h[have:]), 2 * have
    return np.minimum(h[: len(h) - (size - have)], h[size - have :]) if have < size else h
