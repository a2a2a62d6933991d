"""Words between ASCII white space, found and hashed for many texts at once in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np

#: Bytes of text that are handled at once; longer texts are handled alone, whole.
CHUNK = 1 << 18
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
BASE = 0x5851F42D4C957F2D
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


class Words(NamedTuple):
    raw: np.ndarray
    start: np.ndarray
    end: np.ndarray
    owner: np.ndarray
    hash: np.ndarray


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads them."""
    x = (x ^ (x >> np.uint64(31))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(32))


def _powers(base: int, n: int) -> np.ndarray:
    """base^0 ... base^(n-1) modulo 2^64."""
    out = np.ones(max(1, n), np.uint64)
    done = 1
    while done < n:
        m = min(done, n - done)
        out[done : done + m] = out[:m] * np.uint64(pow(base, done, 1 << 64))
        done += m
    return out


class _Table:
    """Powers of the base and of its inverse, grown as needed."""

    up = down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = _powers(BASE, n), _powers(pow(BASE, -1, 1 << 64), n)
        return self.up[:n], self.down[:n]


_TABLE = _Table()


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse."""
    return _TABLE.upto(n)


def chunks(texts: list[bytes | None]) -> Iterator[tuple[int, list[bytes | None]]]:
    """(index of the first, texts) of about CHUNK bytes."""
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t or b"") + 1
        if size and size + n > CHUNK:
            yield start, texts[start:i]
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, texts[start:]


def words_of(texts: list[bytes | None]) -> Words:
    """Words of all texts, A-Z in lower case, by text and place.

    A word's hash is the value of its bytes (plus one) as digits, modulo 2^64, mixed: differences of running
    sums, brought to the word's start by the inverse of the base, so it costs a few operations a byte.
    """
    joined = b"\n".join([*(t or b"" for t in texts), b""]).lower()
    raw = np.frombuffer(joined, np.uint8)
    if not len(raw):
        return Words(raw, *(np.zeros(0, np.int64),) * 3, np.zeros(0, np.uint64))
    space = _SPACE[raw]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate([[0], edge])
    start, end = edge[::2], edge[1::2]  # the last byte is white space
    up, down = _TABLE.upto(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    value = (sums[end] - sums[start]) * down[start]
    ends = np.cumsum([len(t or b"") + 1 for t in texts])
    return Words(raw, start, end, np.searchsorted(ends, start, "right"), mix(value + M2))


class Lookup:
    """Where hashes stand in a sorted table of them: the upper bits lead to a short run."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.append(keys, np.uint64((1 << 64) - 1))
        bits = max(1, min(22, len(keys).bit_length() + 1))
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, whether it is there)."""
        at = self.first[h >> self.shift]
        rest = np.flatnonzero(self.keys[at] < h)
        while len(rest):
            at[rest] += 1
            rest = rest[self.keys[at[rest]] < h[rest]]
        there = (self.keys[at] == h) & (at < len(self.keys) - 1)
        return at, there
