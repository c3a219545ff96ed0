"""Vectorised tokenising and hashing of text batches in numpy, shared by the text operators."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes that end a word of the alphanumeric kind: ASCII other than digits and letters.
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[:128] = True
NOT_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = False

BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)
CHUNK_BYTES = 1 << 21
#: Powers of the hash base are kept in multiples of so many.
POWERS = 1 << 18


class _Powers:
    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers, modulo 2**64, of the hash base and of its inverse."""
    if len(_Powers.up) >= n:
        return _Powers.up[:n], _Powers.down[:n]
    both = []
    for base in (BASE, BASE_INVERSE):
        x = np.full(-(-n // POWERS) * POWERS, base, np.uint64)
        x[0] = 1
        np.cumprod(x, out=x)
        both.append(x)
    if n <= CHUNK_BYTES + 65536:
        _Powers.up, _Powers.down = both
    return both[0][:n], both[1][:n]


def release() -> None:
    """Give freed memory back to the system: a worker outlives its tasks, and what it keeps adds to its executor's memory."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values, so that any bits of them can be used."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xCA5A826395121157)
    x ^= x >> np.uint64(32)
    return x


@dataclass
class Words:
    """Words of several texts: byte bounds in ``buf``, 64-bit hashes, and the first word of each text."""

    buf: np.ndarray
    start: np.ndarray
    end: np.ndarray
    offset: np.ndarray  # len(texts) + 1 positions in start
    bounds: np.ndarray  # len(texts) + 1 positions in buf; a text ends one byte before the next begins
    prefix: np.ndarray

    def hashes(self, start: np.ndarray | None = None, end: np.ndarray | None = None) -> np.ndarray:
        """Hash of each word, or of any byte ranges of ``buf``."""
        s, e = (self.start, self.end) if start is None else (start, end)
        down = powers(len(self.prefix))[1]
        return mix((self.prefix[e] - self.prefix[s]) * down[s])

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offset) - 1), np.diff(self.offset))


def words(raw: list[bytes], separators: np.ndarray = SPACES, hashed: bool = True) -> Words:
    joined = b"\n" + b"\n".join(raw) + b"\n"
    buf = np.frombuffer(joined, np.uint8)
    sep = separators[buf]
    edge = np.flatnonzero(sep[1:] != sep[:-1]) + 1
    start, end = edge[::2], edge[1::2]
    bounds = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(x) + 1 for x in raw], out=bounds[1:])
    bounds += 1
    prefix = np.zeros(0, np.uint64)
    if hashed:
        up, _ = powers(len(buf) + 1)
        prefix = np.zeros(len(buf) + 1, np.uint64)
        # a byte counts from 1, so that a word and the same word with NULs behind it differ
        np.cumsum((buf + np.uint16(1)) * up[: len(buf)], out=prefix[1:])
    return Words(buf, start, end, np.searchsorted(start, bounds), bounds, prefix)


def sums(values: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """Sum of ``values`` between successive offsets, in 64-bit integers."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[offset[1:]] - total[offset[:-1]]


def code_points(buf: np.ndarray) -> np.ndarray:
    """At i, the number of code points that begin before byte i."""
    out = np.zeros(len(buf) + 1, np.int64)
    np.cumsum((buf & 0xC0) != 0x80, out=out[1:])
    return out


def chunks(texts: list, lower: bool = False, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of about ``limit`` bytes of texts (a longer text alone): position of the first, and UTF-8 bytes. Null is empty."""
    first, raw, size = 0, [], 0
    for i, t in enumerate(texts):
        b = t.encode() if isinstance(t, str) else b""
        if lower:
            b = b.lower()
        if raw and size + len(b) > limit:
            yield first, raw
            first, raw, size = i, [], 0
        raw.append(b)
        size += len(b)
    if raw:
        yield first, raw


def repeated(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each key occurs more than once, and whether an equal one stands before it."""
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    again = np.zeros(len(key), bool)
    again[order[1:][same]] = True
    twice = again.copy()
    twice[order[:-1][same]] = True
    return twice, again
