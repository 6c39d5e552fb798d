"""Whitening of embeddings by tall-skinny QR (operator 11).

Entries become whole numbers, so that sums and the centring are exact. Each task reduces its centred rows to the triangular
factor R of their QR decomposition, block by block; the factors of a few tasks are stacked and reduced again, level by level,
to one. Its singular values and right vectors are those of all centred rows: no covariance matrix is formed.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import _scratch

SCALE, COMPONENTS = 256, 4
#: Rows that are worked on at once; factors that are merged into one.
ROWS, FAN = 2048, 4
#: Whole numbers stay below this, so that one fits a long.
_LIMIT = 2.0**63
_DECIMAL = pa.decimal128(38, 0)


def _quantized(vectors: DataFrame, scale: int) -> DataFrame:
    """(vec_id, dims, x) of the vectors without null, non-finite or too large entries; x: floor(scale * entry) of each entry
    as bytes of the narrowest of 16, 32 and 64 bits that holds all of them, so that equal vectors have equal bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                lists = part.column(1)
                sizes = lists.value_lengths().fill_null(0).to_numpy()
                flat = lists.flatten()
                values = np.floor(flat.to_numpy(zero_copy_only=False).astype(np.float64) * scale)
                fine = np.abs(values) < _LIMIT  # false for a null or NaN too
                ends = np.cumsum(sizes)
                bad = np.concatenate([[0], np.cumsum(~fine)])
                keep = np.flatnonzero(lists.is_valid().to_numpy(zero_copy_only=False) & (bad[ends] == bad[ends - sizes]))
                x = np.where(fine, values, 0).astype(np.int64)
                out = []
                for k in keep:
                    v = x[ends[k] - sizes[k] : ends[k]]
                    most = max(int(v.max()), -int(v.min()) - 1) if len(v) else 0
                    out.append(v.astype(np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.int64).tobytes())
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(keep)), pa.array(sizes[keep].astype(np.int32)), pa.array(out, pa.binary())], ["vec_id", "dims", "x"])

    return vectors.mapInArrow(run, "vec_id long, dims int, x binary")


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """The vectors of a column of bytes as rows of longs."""
    out = np.empty((len(column), dims), dtype=np.int64)
    width = pc.binary_length(column).to_numpy() // dims
    for w in np.unique(width):
        these = np.flatnonzero(width == w)
        raw = b"".join(column.take(pa.array(these)).to_pylist())
        out[these] = np.frombuffer(raw, dtype=f"<i{w}").reshape(-1, dims)
    return out


class Model:
    """n fit vectors with the sums S of each dimension; after ``solve`` the components and their variances."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums, self.dims = n, sums, len(sums)

    def numerators(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact: longs where they fit, else Python's whole numbers."""
        most = self.n * max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0
        if most + max(map(abs, self.sums)) < 1 << 62:
            return self.n * x - np.array(self.sums, dtype=np.int64)
        return self.n * x.astype(object) - np.array(self.sums, dtype=object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.numerators(x).astype(np.float64) / self.n

    def deviation(self, x: np.ndarray) -> pa.Array:
        """The sum over dimensions of (n * x - S)**2; null where 38 digits don't hold it."""
        d = self.numerators(x)
        most = int(np.abs(d).max()) if d.size else 0
        if most**2 * self.dims < 1 << 63:
            return pa.array((d * d).sum(axis=1)).cast(_DECIMAL)
        if most < 1 << 48 and self.dims <= 1 << 13:  # squares of two halves of 24 bits
            high, low = d >> 24, d & (1 << 24) - 1
            parts = [(a * b).sum(axis=1).tolist() for a, b in ((high, high), (high, low), (low, low))]
            total = [(a << 48) + (b << 25) + c for a, b, c in zip(*parts, strict=True)]
        else:
            total = [sum(v * v for v in row) for row in d.astype(object).tolist()]
        return pa.array([Decimal(v) if v < 10**38 else None for v in total], _DECIMAL)

    def solve(self, r: np.ndarray, components: int) -> None:
        """Components, a column each, from the factor R of all centred rows; the largest entry of each is positive. A variance of
        zero to double precision is 0, and its component whitens nothing."""
        _, s, vt = np.linalg.svd(r)
        s = np.concatenate([s, np.zeros(self.dims - len(s))])
        s[s <= s[0] * self.dims * np.finfo(np.float64).eps] = 0
        own = min(components, self.dims)
        v = vt[:own].T
        self.vectors = v * np.where(v[np.abs(v).argmax(axis=0), np.arange(own)] < 0, -1.0, 1.0)
        variance = s * s / self.n
        self.variance, self.trace = variance[:own], float(variance.sum())

    def whitened(self, x: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return self.centred(x) @ self.vectors / np.sqrt(self.variance)


def _sums(fit: DataFrame, dims: int) -> list[int]:
    """Exact sums of each dimension: a row for each task and dimension goes to a sum of decimals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * dims
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                x = _matrix(batch.column(0).slice(lo, ROWS), dims)
                high, low = (x >> 32).sum(axis=0).tolist(), (x & 0xFFFFFFFF).sum(axis=0).tolist()
                total = [t + (a << 32) + b for t, a, b in zip(total, high, low, strict=True)]
        if any(total):
            yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int32()), pa.array([Decimal(t) for t in total], _DECIMAL)], ["at", "total"])

    found = fit.select("x").mapInArrow(run, "at int, total decimal(38,0)").groupBy("at").agg(F.sum("total").alias("total"))
    sums = [0] * dims
    for row in found.collect():  # a row for each dimension
        sums[row["at"]] = int(row["total"])
    return sums


def _stacked(parts: list[np.ndarray]) -> np.ndarray:
    return np.linalg.qr(np.vstack(parts), mode="r")


def _factor(fit: DataFrame, model: Model) -> np.ndarray:
    """R of all centred rows: of each task's blocks, then of FAN factors at a time until one is left."""
    dims = model.dims

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = None
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                rows = model.centred(_matrix(batch.column(0).slice(lo, ROWS), dims))
                r = _stacked([rows] if r is None else [r, rows])
        if r is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([r.tobytes()], pa.binary())], ["part", "r"])

    def merge(table: pa.Table) -> pa.Table:
        parts = sorted(zip(table.column("part").to_pylist(), table.column("r").to_pylist(), strict=True))
        r = _stacked([np.frombuffer(raw).reshape(-1, dims) for _, raw in parts])
        return pa.table({"part": pa.array([parts[0][0] // FAN], pa.int64()), "r": pa.array([r.tobytes()], pa.binary())})

    path, rs = _scratch.written_at(fit.select("x").mapInArrow(run, "part long, r binary"), "factors")
    left = rs.agg(F.max("part")).first()[0] + 1
    while left > 1:
        rs = rs.groupBy(F.expr(f"part div {FAN}")).applyInArrow(merge, "part long, r binary")
        left = -(-left // FAN)
    r = np.frombuffer(rs.first()["r"]).reshape(-1, dims)
    _scratch.drop(fit.sparkSession, path)
    return r


def _identity_error(fit: DataFrame, model: Model) -> float:
    """The largest absolute entry of the whitened fit vectors' covariance less the identity, over components that whiten."""
    use = model.variance > 0
    m = int(use.sum())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, cross = np.zeros(m), np.zeros((m, m))
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                w = model.whitened(_matrix(batch.column(0).slice(lo, ROWS), model.dims))[:, use]
                total, cross = total + w.sum(axis=0), cross + w.T @ w
        values = np.concatenate([total, cross.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(range(len(values)), pa.int32()), pa.array(values)], ["at", "v"])

    found = fit.select("x").mapInArrow(run, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()  # m + m * m rows
    values = np.zeros(m + m * m)
    for row in found:
        values[row["at"]] = row["v"]
    mean = values[:m] / model.n
    return float(np.abs(values[m:].reshape(m, m) / model.n - np.outer(mean, mean) - np.eye(m)).max()) if m else 0.0


RESULT = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def whiten(embeddings: DataFrame, components: int = COMPONENTS, scale: int = SCALE, vector: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of each row with a usable vector and each of
    the first ``components`` components (as many as there are dimensions at most), numbered from 1 by falling variance.

    An entry c counts as the whole number x = floor(scale * c). Means, covariance and components are those of the n distinct
    x vectors, each once, with sums S of each dimension. deviation: the sum over dimensions of (n * x - S)**2; whitened: x - S/n
    along the component, over the root of its variance; explained: its share of all variance; identity_error: how far the
    covariance of the whitened distinct vectors is from the identity, one value for all rows.

    Rows give nothing whose vector is null, holds a null, NaN or infinite entry, or one beyond 64 bits once scaled. If vectors
    differ in length, those of the length of most distinct vectors count (of equally many the shorter), others and empty ones give
    nothing. A component of no variance (fewer distinct vectors than dimensions, equal entries) has a null whitened and a
    share of 0; if none has any, explained is 0 and identity_error 0. Repeated rows are rows; a null vec_id stays null; an
    empty table gives no rows; other columns are not read. deviation is null beyond 38 digits.

    Only sums, and one triangular factor of dims x dims, reach the driver; equal vectors are combined before the shuffle.
    """
    spark = embeddings.sparkSession
    vectors = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    rows = _quantized(vectors, scale).where("dims > 0")
    path, fit = _scratch.written_at(rows.select("dims", "x").distinct(), "fit-list")
    size = fit.groupBy("dims").count().orderBy(F.desc("count"), "dims").first()
    if size is None:
        return spark.createDataFrame([], RESULT)
    dims = size["dims"]
    fit = fit.where(F.col("dims") == dims)
    model = Model(size["count"], _sums(fit, dims))
    model.solve(_factor(fit, model), components)
    error = _identity_error(fit, model)
    _scratch.drop(spark, path)
    own = len(model.variance)
    share = model.variance / model.trace if model.trace else np.zeros(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                x, k = _matrix(part.column(1), dims), part.num_rows
                again = pa.array(np.repeat(np.arange(k), own))
                w = np.where(model.variance > 0, model.whitened(x), np.nan).ravel()
                cols = [part.column(0).take(again), pa.array(np.tile(np.arange(1, own + 1, dtype=np.int32), k)), pa.array(np.full(k * own, model.n)), model.deviation(x).take(again)]
                cols += [pa.array(w, mask=np.isnan(w)), pa.array(np.tile(share, k)), pa.array(np.full(k * own, error))]
                yield pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in RESULT.split(", ")])

    return rows.where(F.col("dims") == dims).select("vec_id", "x").mapInArrow(run, RESULT)
