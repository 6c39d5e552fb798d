"""Vectorised word kernel: words, word hashes and shingle hashes of Arrow text columns in numpy.

Words are runs of bytes other than space and \\x09-\\x0D. All functions work on blocks of whole documents
of about BLOCK bytes, so that memory does not depend on the size of an Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

BLOCK = 1 << 19
#: Bytes that are hashed at once.
CHUNK = 1 << 16
_U = np.uint64
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of uint64 whose output bits all depend on all input bits."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _odd(seed: int) -> int:
    return int(mix(np.array([seed * 2 + 1], dtype=np.uint64))[0]) | 1


def _power_table(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    def run(b: int) -> np.ndarray:
        out = np.full(n, b, dtype=np.uint64)
        out[0] = 1
        with np.errstate(over="ignore"):
            return np.multiply.accumulate(out)

    return run(base), run(pow(base, -1, 1 << 64))


_kept_powers = lru_cache(maxsize=8)(_power_table)


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of base and of its inverse. Only tables of up to CHUNK are kept."""
    if n > CHUNK + 1:
        return _power_table(base, n)
    p, q = _kept_powers(base, CHUNK + 1)
    return p[:n], q[:n]


@lru_cache(maxsize=8)
def _byte_codes(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * _U(_odd(seed + 77)))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    column = column.cast(pa.large_string()) if column.type != pa.large_string() else column
    if column.null_count:
        column = column.fill_null("")
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    return data, offsets


def blocks(column: pa.Array, block: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) for runs of whole documents of about ``block`` bytes."""
    data, offsets = text_buffers(column)
    at, n = 0, len(offsets) - 1
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + block, side="right")) - 1
        end = min(max(end, at + 1), n)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def words(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each document and the total) of all words."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    full = ~space[data]
    begin, end = full.copy(), full.copy()
    begin[1:] &= ~full[:-1]
    end[:-1] &= ~full[1:]
    some = offsets[:-1] < offsets[1:]
    first, last = offsets[:-1][some], offsets[1:][some] - 1
    begin[first], end[last] = full[first], full[last]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit polynomial hash of each slice of the bytes, finalised. Slices are in ascending order and apart; those of
    CHUNK bytes are hashed at once, so that memory beyond the result depends on the longest slice alone."""
    base, codes = _odd(seed), _byte_codes(seed)
    out = np.empty(len(starts), dtype=np.uint64)
    at = 0
    while at < len(starts):
        low = int(starts[at])
        upto = max(int(np.searchsorted(ends, low + CHUNK, side="right")), at + 1)
        n = int(ends[upto - 1]) - low
        p, q = powers(base, n + 1)
        with np.errstate(over="ignore"):
            sums = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum(codes[data[low : low + n]] * p[:-1], out=sums[1:])
            first = starts[at:upto] - low
            out[at:upto] = mix((sums[ends[at:upto] - low] - sums[first]) * q[first])
        at = upto
    return out


def gram_hashes(codes: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """The hash of every n consecutive codes, across documents as well: the caller drops what crosses a border. It is
    the polynomial of the codes, put together from those of 1, 2, 4, ... codes."""
    m = len(codes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    base = _odd(seed + 1000)
    total, have, width, h = np.zeros(m, dtype=np.uint64), 0, 1, codes
    with np.errstate(over="ignore"):
        while True:
            if n & width:
                total += h[have : have + m] * _U(pow(base, have, 1 << 64))
                have += width
            if have == n:
                return mix(total)
            h = h[:-width] + h[width:] * _U(pow(base, width, 1 << 64))
            width *= 2


def gram_starts(first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, document of each) at which n consecutive words lie in one document."""
    counts = np.maximum(np.diff(first) - n + 1, 0)
    doc = np.repeat(np.arange(len(counts)), counts)
    return np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts) + first[:-1][doc], doc


def shingle_sets(codes: np.ndarray, first: np.ndarray, n: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of every n-word shingle, repeats included; a document of fewer words has its whole
    sequence as its only shingle, one without words has a reserved one."""
    at, doc = gram_starts(first, n)
    full = gram_hashes(codes, n, seed)[at] if len(at) else np.zeros(0, np.uint64)
    count = np.diff(first)
    short = np.flatnonzero(count < n)
    if not len(short):
        return full, doc
    extra = np.full(len(short), 0x5EEDED0C, dtype=np.uint64)
    for length in range(1, n):
        these = count[short] == length
        if these.any():
            extra[these] = gram_hashes(codes, length, seed + length)[first[:-1][short[these]]]
    return np.concatenate([full, extra]), np.concatenate([doc, short])
