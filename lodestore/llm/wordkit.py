"""Vectorised word splitting and hashing over a slice of UTF-8 texts.

A slice is one byte array with the texts one after another. Words are found with
numpy over the bytes, hashed eight bytes at a time, and shingles are mixed from
word hashes, so the cost is a few nanoseconds a byte without a Python loop over words.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from lodestore.llm.common import string_parts

_U = np.uint64
_M1, _M2, _M3 = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)

#: Bytes that part words: space and \t \n \v \f \r.
SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes outside [0-9a-z] and non-ASCII, for texts that are lower-cased first.
NON_ALNUM = np.ones(256, dtype=bool)
NON_ALNUM[0x30:0x3A] = NON_ALNUM[0x61:0x7B] = NON_ALNUM[0x80:] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
#: Spans of more bytes are hashed one by one: all others step together, eight bytes at a time.
_LONG_SPAN = 2048
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; maps distinct values to distinct values."""
    h = (h ^ (h >> _U(30))) * _M2
    h = (h ^ (h >> _U(27))) * _M3
    return h ^ (h >> _U(31))


@dataclass
class Words:
    data: np.ndarray  # bytes of the slice, lower-cased if asked for
    start: np.ndarray  # first byte of each word
    end: np.ndarray
    doc: np.ndarray  # row of each word
    first: np.ndarray  # for each row, the index of its first word; one entry more than rows

    def hashes(self) -> np.ndarray:
        return hash_spans(self.data, self.start, self.end)


def flat(column: pa.Array, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """The slice's bytes and, with one entry more than rows, where each text starts."""
    raw, off, length = string_parts(column)
    at = np.concatenate([[0], np.cumsum(length)])
    if len(off) and at[-1] and off[-1] + length[-1] - off[0] == at[-1]:
        data = raw[off[0] : off[0] + at[-1]]
    else:
        data = np.concatenate([raw[o : o + n] for o, n in zip(off, length)] or [raw[:0]])
    return (_LOWER[data] if lower else data), at


def split(column: pa.Array, gaps: np.ndarray = SPACES, lower: bool = True) -> Words:
    data, at = flat(column, lower)
    n = len(data)
    inside = np.zeros(n + 2, dtype=bool)
    inside[1:-1] = ~gaps[data]
    begin = inside[1:-1] & ~inside[:-2]
    stop = inside[1:-1] & ~inside[2:]
    edge = at[1:-1]
    edge = edge[(edge > 0) & (edge < n)]
    begin[edge] |= inside[1:-1][edge]
    stop[edge - 1] |= inside[1:-1][edge - 1]
    start, end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    first = np.searchsorted(start, at)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(first))
    return Words(data, start, end, doc, first)


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span."""
    if not len(start):
        return np.zeros(0, np.uint64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.ndarray(shape=(len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    size = end - start
    h = mix(size.astype(np.uint64) * _M1 ^ (lanes[start] & _MASK[np.minimum(size, 8)]))
    for k in np.flatnonzero(size > _LONG_SPAN).tolist():
        h[k] = int.from_bytes(hashlib.blake2b(data[start[k] : end[k]].tobytes(), digest_size=8).digest(), "little")
    left, done = np.flatnonzero((size > 8) & (size <= _LONG_SPAN)), 8
    while len(left):
        rest = size[left] - done
        h[left] = mix(h[left] * _M1 + (lanes[start[left] + done] & _MASK[np.minimum(rest, 8)]))
        left, done = left[rest > 8], done + 8
    return h


def shingles(h: np.ndarray, width: int) -> np.ndarray:
    """A hash for each run of ``width`` words of one text; a shorter text is one run, an empty one none."""
    n = len(h)
    if n == 0:
        return h
    width = min(width, n)
    out = h[: n - width + 1].copy()
    for k in range(1, width):
        out = mix(out * _M1 + h[k : n - width + 1 + k])
    return mix(out + _U(width))
