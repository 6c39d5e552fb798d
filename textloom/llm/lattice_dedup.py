"""Embedding near-duplicates by lattice hashing: E8 cells of random projections (operator 7)."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import _graph, _scratch
from textloom.llm._runs import by_runs, joined

#: By lattice points that name a cell together: tables, neighbouring cells that a vector also visits in each, and the length
#: in the lattice that two vectors at the threshold have between them on average. Each choice finds over 0.99 of the pairs
#: at a cosine of 0.98, in 16, 64 and 128 dimensions.
PLANS = {1: (3, 4, 0.5), 2: (6, 8, 0.4), 3: (10, 16, 0.4)}
#: Cells over which one lattice point spreads vectors, about; vectors of a label to a cell from which a point more names it.
SPREAD, DENSE = 3000, 64
#: Rows of a cell's chunk; rows of a run up to which its pairs are compared side by side with those of other runs.
CHUNK, SHORT_RUN = 4096, 32


def _minimal() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    pairs = [(i, j, a, b) for i, j in itertools.combinations(range(8), 2) for a in (1, -1) for b in (1, -1)]
    whole = np.zeros((len(pairs), 8))
    for k, (i, j, a, b) in enumerate(pairs):
        whole[k, [i, j]] = a, b
    half = np.array([s for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0])
    return np.concatenate([whole, half])


MINIMAL = _minimal()


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    out = np.rint(x)
    off = x - out
    odd = np.flatnonzero(out.sum(axis=1) % 2)
    worst = np.abs(off[odd]).argmax(axis=1)
    out[odd, worst] += np.where(off[odd, worst] >= 0, 1, -1)
    return out


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """The closest point of E8 = D8 and D8 + 1/2 to each row."""
    a, b = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1))[:, None], a, b)


def points_for(vectors: int) -> int:
    """Lattice points to a cell's name, so that of so many vectors of a label few share a cell by chance."""
    return min(max(PLANS), max(1, int(np.ceil(np.log(max(1, vectors) / DENSE) / np.log(SPREAD)))))


def cells(x: np.ndarray, similarity: float, points: int = 1, seed: int = 8) -> np.ndarray:
    """(n, tables, 1 + probes) codes: in each table a unit vector's own cell, then the neighbours nearest to it. A cell is
    named by the lattice points of ``points`` projections; a neighbour has another one in one of them. The scale follows
    from the threshold: two vectors at it differ by a set length in the lattice, whatever their dimensions."""
    tables, probes, apart = PLANS[points]
    rng = np.random.default_rng(seed)
    n, size = x.shape
    scale = apart / np.sqrt(max(2 * (1 - similarity), 1e-9) * min(8, size) / size)
    out = np.empty((n, tables, 1 + probes), dtype=np.int64)
    for t in range(tables):
        near, step, base = [], [], np.zeros(n, dtype=np.int64)
        for _ in range(points):
            to = np.linalg.qr(rng.standard_normal((max(size, 8), 8)))[0][:size]
            code = rng.integers(1, 1 << 62, 8)
            y = x @ to * scale + rng.random(8)
            own = nearest_e8(y)
            base += ((2 * own).astype(np.int64) * code).sum(axis=1)
            near.append((y - own) @ MINIMAL.T)
            step.append(((2 * MINIMAL).astype(np.int64) * code).sum(axis=1))
        first = np.argsort(-np.concatenate(near, axis=1), axis=1, kind="stable")[:, :probes]
        out[:, t, 0] = base
        out[:, t, 1:] = base[:, None] + np.concatenate(step)[first]
    return out


def _first_meeting(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For pairs of rows of cells: the first table in which they meet, and the cell in which it counts: of a's own and
    b's own cell the first that the other visits."""
    hit_a = (a[:, :, :1] == b).any(axis=2)
    hit_b = (b[:, :, :1] == a).any(axis=2)
    table = (hit_a | hit_b).argmax(axis=1)
    row = np.arange(len(a))
    return table, np.where(hit_a[row, table], a[row, table, 0], b[row, table, 0])


def near_vectors(vectors: DataFrame, similarity: float = 0.98) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vector.

    Vectors of one label (not null) link if lattice hashing brings them together and their cosine, in double precision,
    is at least ``similarity``. Null and zero vectors, and those with null or non-finite components, have no link;
    vectors of other lengths than the first length's kind only meet their own length. n_links counts other vectors
    linked directly, equal copies included; component_id is the smallest vec_id that links reach. A null vec_id has no
    component; repeated rows of a vec_id are copies of one vector; an empty table gives no rows.

    Equal vectors are one class, which carries its size. Each class visits its own cell and its neighbours in each table
    (PLANS); in a cell, those whose own cell it is meet all its visitors. A pair counts in the first cell in which it
    meets, so that no pair leaves a task: only each class's number of links and a spanning forest do. Cells are sorted
    runs; one of over CHUNK rows is dealt out as pairs of chunks.
    """
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("e"))
    finite = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.col("e").isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists("e", lambda x: x != 0)
    good = own.where(usable)
    classes = _scratch.written(good.groupBy("label", "e").agg(F.min("vec_id").alias("cid"), F.count("*").alias("size")), "vector-classes")
    most = classes.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first()["n"] or 0
    points = points_for(most)
    tables, probes, _ = PLANS[points]

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column(1).value_lengths().to_numpy()
            for n in np.unique(lengths):
                every = batch.filter(pa.array(lengths == n))
                for lo in range(0, every.num_rows, 1024):
                    part = every.slice(lo, 1024)
                    x = part.column(1).flatten().to_numpy().reshape(-1, n)
                    x = x / np.abs(x).max(axis=1, keepdims=True)  # no square overflows or vanishes
                    unit = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
                    c = cells(unit, similarity, points)
                    m, visits = len(x), tables * (1 + probes)
                    at = np.repeat(np.arange(m), visits)
                    rows = [part.column(0).take(pa.array(at)), pa.array(np.full(len(at), n, np.int32)), pa.array(np.tile(np.repeat(np.arange(tables, dtype=np.int32), 1 + probes), m)), pa.array(c.reshape(-1))]
                    rows += [pa.array(np.tile(np.arange(1 + probes) == 0, m * tables)), part.column(2).take(pa.array(at)), part.column(3).take(pa.array(at))]
                    rows += [pa.array([r.tobytes() for r in unit], pa.binary()).take(pa.array(at)), pa.array([r.tobytes() for r in c], pa.binary()).take(pa.array(at))]
                    yield pa.RecordBatch.from_arrays(rows, ["label", "n", "t", "cell", "home", "cid", "size", "x", "c"])

    visits = classes.select("label", "e", "cid", "size").mapInArrow(visit, "label long, n int, t int, cell long, home boolean, cid long, size long, x binary, c binary")
    key = ["label", "n", "t", "cell"]
    counts = visits.groupBy(*key).agg(F.count("*").alias("m"), F.count_if("home").alias("homes")).where("m > 1 and homes > 0")
    pieces = F.ceil(F.col("m") / CHUNK).cast("int")
    dealt = visits.join(counts.select(*key, pieces.alias("k")), key).withColumn("mine", F.pmod(F.xxhash64("cid"), F.col("k")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).withColumn("lo", F.least("mine", "other")).withColumn("hi", F.greatest("mine", "other"))
    run_key = [*key, "lo", "hi"]
    runs = dealt.repartition(*run_key).sortWithinPartitions(*run_key).select(*run_key, "home", "cid", "size", "mine", "x", "c")

    def of_length(rows: pa.Table, first: np.ndarray) -> Iterator[pa.RecordBatch]:
        """``meet`` on the runs of each length of vectors."""
        n, end = rows.column("n").to_numpy(), np.append(first[1:], rows.num_rows)
        cuts = [0, *(np.flatnonzero(n[first][1:] != n[first][:-1]) + 1).tolist(), len(first)]
        for a, z in zip(cuts, cuts[1:], strict=False):
            yield from meet(rows.slice(first[a], end[z - 1] - first[a]), first[a:z] - first[a])

    def meet(rows: pa.Table, first: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Links of whole runs, all of vectors of one length."""
        _, n, t, cell, lo, hi, home, cid, size, mine = (rows.column(k).to_numpy() for k in range(10))
        x = np.frombuffer(b"".join(rows.column("x").to_pylist()), dtype=np.float64).reshape(len(n), -1)
        c = np.frombuffer(b"".join(rows.column("c").to_pylist()), dtype=np.int64).reshape(len(n), tables, 1 + probes)
        end = np.append(first[1:], len(n))
        run = np.repeat(np.arange(len(first)), end - first)
        links, name = np.zeros(len(n), dtype=np.int64), np.arange(len(n))

        def linked(i: np.ndarray, j: np.ndarray) -> None:
            nonlocal name
            keep = (home[i] | home[j]) & ((lo[i] == hi[i]) | (mine[i] != mine[j]))
            i, j = i[keep], j[keep]
            swap = cid[i] > cid[j]
            i, j = np.where(swap, j, i), np.where(swap, i, j)
            table_of, cell_of = _first_meeting(c[i], c[j])
            keep = (table_of == t[i]) & (cell_of == cell[i])
            i, j = i[keep], j[keep]
            np.add.at(links, i, size[j])
            np.add.at(links, j, size[i])
            name = joined(name, i, j)

        i = np.flatnonzero((end - first)[run] <= SHORT_RUN)
        for d in range(1, SHORT_RUN):
            i = i[i + d < end[run[i]]]
            for a in range(0, len(i), 1 << 14):
                p = i[a : a + (1 << 14)]
                near = np.einsum("ij,ij->i", x[p], x[p + d]) >= similarity
                linked(p[near], p[near] + d)
        for k in np.flatnonzero(end - first > SHORT_RUN).tolist():
            a, z = int(first[k]), int(end[k])
            for b in range(a, z, 1024):
                i, j = np.nonzero(x[b : min(b + 1024, z)] @ x[a:z].T >= similarity)
                i, j = i + b, j + a
                later = i < j
                i, j = i[later], j[later]
                for q in range(0, len(i), 1 << 16):
                    linked(i[q : q + (1 << 16)], j[q : q + (1 << 16)])
        some = np.flatnonzero((links > 0) | (name != np.arange(len(n))))
        yield pa.RecordBatch.from_arrays([pa.array(cid[some]), pa.array(links[some]), pa.array(cid[name[some]])], ["cid", "links", "to"])

    found = runs.mapInArrow(lambda batches: by_runs(batches, len(run_key), of_length), "cid long, links long, to long")
    found = _scratch.written(found, "vector-links")
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    graph = _graph.components(found.select(F.col("cid").alias("src"), F.col("to").alias("dst")))
    told = classes.join(links, "cid", "left").join(graph, classes.cid == graph.node, "left")
    told = told.select("label", "e", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component", "cid").alias("component_id"))
    out = good.join(told, ["label", "e"]).select("vec_id", "n_links", "component_id")
    alone = own.where(~F.coalesce(usable, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionAll(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
