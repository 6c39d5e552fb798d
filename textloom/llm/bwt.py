"""Burrows-Wheeler transforms of shards of texts, and their merge by refinement of the interleave.

A shard sorts the suffixes of its texts once. Merging shards sorts no suffix again: the merged order keeps each shard's own
order, so all it takes is the interleave, the number of a shard at each merged place. At first no symbol is known, and all
places are one block. A round walks the places in their present order, takes for each the next symbol that its shard's
transform has (the bytes that stand before the suffix), and deals the places stably by these symbols: that is the interleave
of the suffixes which begin one symbol earlier, known to one symbol more. Neighbours fall into different blocks in the round
that first tells them apart, which gives their common prefix in symbols; neighbours that no round tells apart are the
repeated intervals.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64


def stride_for(length: int) -> int:
    """Bytes of a symbol: the most, up to 10, that divide the length."""
    return next(s for s in range(10, 0, -1) if length % s == 0)


def _symbols(data: np.ndarray, width: int) -> np.ndarray:
    """For each place the ``width`` bytes from there as a whole number; the data's beginning follows its end."""
    wide = np.concatenate([data, np.resize(data, width)]).astype(np.uint64)
    out = np.zeros(len(data), np.uint64)
    for k in range(width):
        out = out << _U(8) | wide[k : k + len(data)]
    return out


class Shard:
    """The places of some concatenated texts in the order of the ``length`` bytes from each, and the transform: for each place
    in that order the symbol just before it. What follows the last text is the first one, so places whose bytes run over
    their text's end are ordered by bytes of another; only those with length bytes of their own are of use."""

    def __init__(self, data: np.ndarray, length: int):
        n, stride = len(data), stride_for(length)
        have = next(s for s in (8, 4, 2, 1) if s <= length)
        key = _symbols(data, have)
        while True:
            order = np.argsort(key)
            rank = np.empty(n, dtype=np.int64)
            rank[order] = np.cumsum(np.concatenate([[0], key[order][1:] != key[order][:-1]]))
            if have == length or int(rank.max()) == n - 1:
                break
            step = min(have, length - have)  # bytes known of the place that many bytes on are added
            key, have = rank * n + np.roll(rank, -(step % n)), have + step
        self.places = order
        #: Halves of the symbols, as whole numbers.
        half = stride // 2
        halves = [(stride, half), (stride - half, stride - half)] if half else [(stride, stride)]
        self.transform = [np.roll(_symbols(data, width), back % n)[order] for back, width in halves]

    def __len__(self) -> int:
        return len(self.places)


def _counted(keys: np.ndarray) -> np.ndarray:
    """A stable order of whole numbers under 2**32, by counts of 16 bits at a time."""
    order = np.argsort(keys.astype(np.uint16), kind="stable")
    high = (keys >> 16).astype(np.uint16)
    return order[np.argsort(high[order], kind="stable")] if high.any() else order


def merge(shards: list[Shard], length: int) -> tuple[np.ndarray, np.ndarray]:
    """(interleave, common): the shard at each merged place, and how many symbols each place has in common with the one
    before, up to length // stride: there, the ``length`` bytes are equal. The first has 0 in common."""
    rounds = length // stride_for(length)
    sizes = [len(s) for s in shards]
    code = np.zeros(sum(sizes), dtype=np.int64)
    for halves in zip(*(s.transform for s in shards), strict=True):
        more = np.unique(np.concatenate(halves), return_inverse=True)[1]
        code = np.unique(code * (int(more.max(initial=0)) + 1) + more, return_inverse=True)[1] if code.any() else more
    code = code.astype(np.uint16 if code.max(initial=0) < 1 << 16 else np.uint32)
    z = np.repeat(np.arange(len(shards)), sizes).astype(np.uint8 if len(shards) < 256 else np.uint16)
    block = np.zeros(len(z), dtype=np.int32)
    told = np.zeros(len(z), dtype=bool)  # places that begin a block; they stay where they are
    common = np.full(len(z), rounds, dtype=np.int32)
    common[:1] = 0
    for k in range(rounds):
        symbol = np.empty_like(code)
        symbol[np.argsort(z, kind="stable")] = code
        order = _counted(symbol)
        symbol, block, z = symbol[order], block[order], z[order]
        new = told.copy()
        new[1:] = (symbol[1:] != symbol[:-1]) | (block[1:] != block[:-1])
        common[new & ~told] = k
        told, block = new, np.cumsum(new, dtype=np.int32)
    return z, common


def classes(shards: list[Shard], length: int) -> list[np.ndarray]:
    """For each shard, by place in its data: the number of the interval of places with the same ``length`` bytes."""
    z, common = merge(shards, length)
    number = np.cumsum(common < length // stride_for(length), dtype=np.int64)[np.argsort(z, kind="stable")]
    out, at = [], 0
    for s in shards:
        own = np.empty(len(s), dtype=np.int64)
        own[s.places] = number[at : at + len(s)]
        out.append(own)
        at += len(s)
    return out
