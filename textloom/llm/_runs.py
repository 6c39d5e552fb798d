"""Sorted runs of equal keys in a stream of Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Rows that are looked at together at least.
SLICE = 4096


def by_runs(batches: Iterator[pa.RecordBatch], keys: int, work: Callable[[pa.Table, np.ndarray], Iterator[pa.RecordBatch]], size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """work(rows, first) on tables of whole runs of equal leading ``keys`` columns, which rows are sorted by; first are the
    places of the runs' first rows; a table has about ``size`` rows or one longer run. Of the runs only one that goes on in the next rows is held over."""
    held: list[pa.RecordBatch] = []
    held_key: tuple = ()

    def begins(cols: list[np.ndarray]) -> np.ndarray:
        new = np.zeros(len(cols[0]), dtype=bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        return new

    def done(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(parts)
        if rows.num_rows:
            new = begins([rows.column(k).to_numpy() for k in range(keys)])
            new[0] = True
            yield from work(rows, np.flatnonzero(new))

    for batch in batches:
        for lo in range(0, batch.num_rows, size):
            part = batch.slice(lo, size)
            cols = [part.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
            new = begins(cols)
            new[0] = held_key != tuple(c[0] for c in cols)
            held_key = tuple(c[-1] for c in cols)
            if new.any():
                last = int(np.flatnonzero(new)[-1])  # the run from there may go on
                yield from done([*held, part.slice(0, last)])
                held, part = [], part.slice(last)
            held.append(part)
    if held:
        yield from done(held)


def joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (smallest row of each component) after also joining the rows a and b pairwise."""
    while True:
        x, y = label[a], label[b]
        low, high = np.minimum(x, y), np.maximum(x, y)
        keep = low != high
        if not keep.any():
            return label
        a, b, low, high = a[keep], b[keep], low[keep], high[keep]
        label = label.copy()
        np.minimum.at(label, high, low)
        while (label != label[label]).any():
            label = label[label]
