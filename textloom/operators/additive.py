"""Additive boosted models: a lookup table of scores for each feature's bins.

Models of few values are fitted one to a task. Of more, all tasks count, and only counts of bins are ever in one place: a
regressor's rounds need nothing but how many rows two bins share and the labels' sum in each; in a step of a classifier
tasks that hold its rows give each other their sums of gradients."""

from __future__ import annotations

import struct
import time
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import BarrierTaskContext, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.functions import scalars as S
from textloom.operators import information, relational
from textloom.sources import files

BINS, RATE, ROUNDS = 128, 0.04, 200
#: Parts into which a smoothing round cuts a feature's bins.
LEAVES = 3
#: Values (rows times features) of a job up to which its model is fitted in one task, and bins of all features up to which
#: the counts of pairs of bins are one matrix.
TASK_VALUES, PAIRED_BINS = 6_000_000, 6_000
#: Cells of a block of a classifier's rows.
BLOCK = 1 << 15
#: Cells for which another task is worth what tasks tell each other, which grows with the square of their number; the most
#: tasks; and bytes that a task holds through a classifier's rounds.
TASK_CELLS, MOST_TASKS, STATE = 1 << 18, 64, 1 << 29
TERMS = "model string, feature string, bin int, low double, output string, score double"


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    some = x[~np.isnan(x)]
    return np.unique(np.quantile(some, np.arange(1, bins) / bins)) if len(some) else np.zeros(0)


def fit_arrays(x: np.ndarray, y: np.ndarray, names: list[str], outputs: list[str] | None, rounds: int = ROUNDS, rate: float = RATE, bins: int = BINS, smoothing: int | None = None) -> pd.DataFrame:
    """The terms of a model: cyclic boosting, each step the mean (or Newton) step of every bin of one feature, shrunk by
    rate. The first ``smoothing`` rounds (min(50, rounds // 4) if not given) step by LEAVES runs of bins between random
    cuts instead, the missing bin apart, which sets the broad shape first. outputs: the classes of a classifier with balanced class weights, None for a regressor. Bin 0 is missing; the
    intercept is the feature ''."""
    n, f = x.shape
    edges = [_edges(x[:, j], bins) for j in range(f)]
    binned = [np.where(np.isnan(x[:, j]), 0, np.searchsorted(edges[j], x[:, j], "right") + 1) for j in range(f)]
    k = len(outputs) if outputs else 1
    scores = [np.zeros((len(e) + 2, k)) for e in edges]
    if outputs:
        at = {c: i for i, c in enumerate(outputs)}
        code = np.array([at[c] for c in y])
        count = np.bincount(code, minlength=k)
        weight = (n / (np.maximum(count, 1) * (count > 0).sum()))[code]
        start, truth = np.zeros(k), np.eye(k)[code]
    else:
        y = y.astype(float)
        weight, start = np.ones(n), np.array([y.mean()])
    z = np.tile(start, (n, 1))
    smoothing = min(50, rounds // 4) if smoothing is None else smoothing
    rng = np.random.default_rng(0)
    for done in range(rounds):
        for j in range(f):
            if outputs:
                p = np.exp(z - z.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                grad, hess = (truth - p) * weight[:, None], p * (1 - p) * weight[:, None]
            else:
                grad, hess = (y[:, None] - z), np.ones((n, 1))
            size = len(edges[j]) + 2
            g = np.stack([np.bincount(binned[j], grad[:, c], size) for c in range(k)], axis=1)
            h = np.stack([np.bincount(binned[j], hess[:, c], size) for c in range(k)], axis=1)
            if done < smoothing:
                g, h = _smooth(rng, g, h)
            step = rate * g / (h + 1.0)
            scores[j] += step
            z += step[binned[j]]
    return _terms(names, edges, scores, start, outputs, [np.bincount(binned[j], minlength=len(edges[j]) + 2) for j in range(f)])


def _smooth(rng: np.random.Generator, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sums of a feature's bins (bin, output), each replaced by that of its run between random cuts."""
    size = len(g)
    cuts = np.sort(rng.choice(np.arange(2, size), min(LEAVES - 1, size - 2), replace=False))
    leaf = np.concatenate([[0], 1 + np.searchsorted(cuts, np.arange(1, size), "right")])
    return tuple(np.stack([np.bincount(leaf, s[:, c])[leaf] for c in range(s.shape[1])], axis=1) for s in (g, h))


def _terms(names: list[str], edges: list[np.ndarray], scores: list[np.ndarray], start: np.ndarray, outputs: list[str] | None, count: list[np.ndarray]) -> pd.DataFrame:
    """A model's terms, each feature's scores less their mean over the rows, which ``count`` has by bin."""
    k = len(start)
    rows = [("", 0, np.nan, o, float(s)) for o, s in zip(outputs or ["value"], start, strict=True)]
    for j, name in enumerate(names):
        mean = count[j] @ scores[j] / count[j].sum()
        for b in range(len(edges[j]) + 2):
            low = np.nan if b == 0 else (-np.inf if b == 1 else edges[j][b - 2])
            rows += [(name, b, low, o, float(s - m)) for o, s, m in zip(outputs or ["value"], scores[j][b], mean, strict=True)]
        for i in range(k):
            rows[i] = (*rows[i][:4], rows[i][4] + float(mean[i]))
    return pd.DataFrame(rows, columns=["feature", "bin", "low", "output", "score"])


def _binned(columns: list[pa.Array], edges: list[np.ndarray]) -> np.ndarray:
    """(row, feature): the bins of Arrow columns of values."""
    out = np.zeros((len(columns[0]), len(edges)), dtype=np.int16)
    for j, (c, e) in enumerate(zip(columns, edges, strict=True)):
        x = c.to_numpy(zero_copy_only=False).astype(float)
        out[:, j] = np.where(np.isnan(x), 0, np.searchsorted(e, x, "right") + 1)
    return out


def _paired(rows: DataFrame, columns: list[str], edges: list[np.ndarray]) -> np.ndarray:
    """(bin, bin + 1): how many rows two bins share, the bins of all features after each other, and the sums of y last."""
    size = [len(e) + 2 for e in edges]
    at = np.concatenate([[0], np.cumsum(size)])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((at[-1], at[-1] + 1))
        for batch in batches:
            y = batch.column(0).to_numpy(zero_copy_only=False).astype(float)
            code = _binned(batch.columns[1:], edges).astype(np.int64)
            for i in range(len(edges)):
                out[at[i] : at[i + 1], -1] += np.bincount(code[:, i], y, size[i])
                for j in range(i, len(edges)):
                    out[at[i] : at[i + 1], at[j] : at[j + 1]] += np.bincount(code[:, i] * size[j] + code[:, j], minlength=size[i] * size[j]).reshape(size[i], size[j])
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], ["sums"])

    add = lambda a, b: (np.frombuffer(a) + np.frombuffer(b)).tobytes()
    own = rows.select("y", *columns).mapInArrow(count, "sums binary").rdd.map(lambda r: bytes(r["sums"]))
    out = np.frombuffer(own.treeReduce(add, depth=3)).reshape(at[-1], at[-1] + 1).copy()
    pair = out[:, :-1]
    out[:, :-1] = pair + pair.T - np.diag(np.diag(pair))
    return out


def fit_sums(paired: np.ndarray, edges: list[np.ndarray], names: list[str], use: list[int], rounds: int, rate: float = RATE, smoothing: int | None = None) -> pd.DataFrame:
    """What ``fit_arrays`` gives for a regressor on the features of the places ``use``, from the sums of ``_paired``: the
    residuals' sum in a bin is the labels' less the scores of all bins by the rows that they share with it."""
    at = np.concatenate([[0], np.cumsum([len(e) + 2 for e in edges])])
    part = [np.arange(at[j], at[j + 1]) for j in use]
    own = np.concatenate(part)
    shared, label = paired[np.ix_(own, own)], paired[own, -1]
    place = np.concatenate([[0], np.cumsum([len(p) for p in part])])
    count = np.diag(shared)
    first = slice(place[0], place[1])
    start = label[first].sum() / count[first].sum()
    score = np.zeros(len(own))
    smoothing = min(50, rounds // 4) if smoothing is None else smoothing
    rng = np.random.default_rng(0)
    for done in range(rounds):
        for j in range(len(use)):
            mine = slice(place[j], place[j + 1])
            g, h = (label[mine] - start * count[mine] - shared[mine] @ score)[:, None], count[mine][:, None]
            if done < smoothing:
                g, h = _smooth(rng, g, h)
            score[mine] += (rate * g / (h + 1.0))[:, 0]
    slices = [slice(place[j], place[j + 1]) for j in range(len(use))]
    return _terms([names[j] for j in use], [edges[j] for j in use], [score[m][:, None] for m in slices], np.array([start]), None, [count[m] for m in slices])


def _cells(rows: DataFrame, columns: list[str], edges: list[np.ndarray], sets: list[list[int]]) -> DataFrame:
    """(model, y, cell): a row of each model for each row; cell: its bins, two bytes each."""

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = _binned(batch.columns[1:], edges)
            for m, use in enumerate(sets):
                raw = np.ascontiguousarray(code[:, use]).tobytes()
                cell = pa.Array.from_buffers(pa.binary(2 * len(use)), batch.num_rows, [None, pa.py_buffer(raw)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, m, np.int32)), batch.column(0), cell], ["model", "y", "cell"])

    return rows.select("y", *columns).mapInArrow(one, "model int, y string, cell binary")


def fit_steps(rows: DataFrame, columns: list[str], edges: list[np.ndarray], names: list[str], sets: list[list[int]], classes: dict[str, int], rounds: int, rate: float = RATE) -> list[pd.DataFrame]:
    """What ``fit_arrays`` gives for classifiers on the features of the places in each of ``sets``, over the same rows: all
    models step side by side. Tasks of one stage give each other their sums in a mounted folder that they share; where there
    is none, or executors come and go (dynamic allocation), which such a stage does not allow, each step is a job."""
    outputs = sorted(classes)
    weight = sum(classes.values()) / (np.array([classes[o] for o in outputs]) * float(len(outputs)))
    cells, size = _cells(rows, columns, edges, sets), [[len(edges[j]) + 2 for j in use] for use in sets]
    context = rows.sparkSession.sparkContext
    moving = context.getConf().get("spark.dynamicAllocation.enabled", "false") == "true"
    folder = None if moving else files.mounted(rows.sparkSession, "sums")
    if folder is None:
        found = _steps_as_jobs(cells, size, outputs, weight, rounds, rate)
    else:
        try:
            found = _steps_together(cells, size, outputs, weight, rounds, rate, folder)
        finally:
            files.drop(folder)
    return [_terms([names[j] for j in use], [edges[j] for j in use], scores, np.zeros(len(outputs)), outputs, count) for use, (scores, count) in zip(sets, found, strict=True)]


def _steps_together(cells: DataFrame, size: list[list[int]], outputs: list[str], weight: np.ndarray, rounds: int, rate: float, folder: str) -> list[tuple]:
    """For each model the scores (bin, class) and the numbers of rows of its features' bins.

    Equal rows of a model are one cell with a count for each class. A task holds its cells with their scores so far through
    all rounds of a barrier stage; in a step each task sums the gradients for the bins of each model's next feature, and
    gets those of the others from their files in folder (a gather of the stage's own waits for a whole second). Models that
    would take more than STATE together follow each other in stages of their own."""
    spark = cells.sparkSession
    k, most = len(outputs), max(map(len, size), default=0)
    smoothing = min(50, rounds // 4)
    context = spark.sparkContext._jsc.sc()
    slots = min(MOST_TASKS, context.maxNumConcurrentTasks(context.resourceProfileManager().resourceProfileFromId(0)))

    def run(group: list[int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            here = BarrierTaskContext.get()
            parts: dict[int, list[tuple]] = {m: [] for m in group}
            for batch in batches:
                model = batch.column(0).to_numpy()
                n = np.stack([c.to_numpy() for c in batch.columns[2:]]).astype(float)
                for m in np.unique(model):
                    at = np.flatnonzero(model == m)
                    cell = np.frombuffer(b"".join(batch.column(1).take(pa.array(at)).to_pylist()), np.int16).reshape(len(at), len(size[m]))
                    parts[m].append((np.ascontiguousarray(cell.T), n[:, at]))

            told = here.allGather(uuid.uuid4().hex)
            name, count_of_tasks, turn = f"{folder}/{told[0]}", len(told), 0  # another name if the stage runs again

            def total(own: list[np.ndarray]) -> list[np.ndarray]:
                """The sums of these arrays over all tasks, in the same order in each of them. A file is written over two
                turns later, when all tasks have read it; one that is not of this turn or not whole is read again."""
                nonlocal turn
                turn += 1
                flat = np.concatenate([a.ravel() for a in own])
                if count_of_tasks > 1:
                    body = flat.tobytes()
                    with open(f"{name}-{here.partitionId()}-{turn % 2}", "wb") as out:
                        out.write(struct.pack("<qq", turn, zlib.crc32(body)) + body)
                    flat = np.zeros(len(flat))
                    for other in range(count_of_tasks):
                        while (told := _of_turn(f"{name}-{other}-{turn % 2}", turn)) is None:
                            time.sleep(0.001)
                        flat += told
                return [x.reshape(a.shape) for a, x in zip(own, np.split(flat, np.cumsum([a.size for a in own])[:-1]), strict=True)]

            code, w, z, own = {}, {}, {}, []
            for m in group:
                if parts[m]:
                    code[m], n = (np.concatenate(x, axis=1) for x in zip(*parts.pop(m), strict=True))
                    w[m], z[m] = weight @ n, np.zeros((k, n.shape[1]))
                for j, bins in enumerate(size[m]):
                    own.append(np.stack([np.bincount(code[m][j], c, bins) for c in n], axis=1) if m in code else np.zeros((bins, k)))
            every = iter(total(own))
            counts = {m: [next(every) for _ in size[m]] for m in group}
            scores = {m: [np.zeros((bins, k)) for bins in size[m]] for m in group}
            rng = {m: np.random.default_rng(0) for m in group}
            for done in range(rounds):
                for step in range(most):
                    mine = [m for m in group if step < len(size[m])]
                    if not mine:
                        break
                    own = [np.zeros((2, k, size[m][step])) for m in mine]
                    for m, sums in zip(mine, own, strict=True):
                        for lo in range(0, len(w[m]) if m in w else 0, BLOCK):
                            p, at = z[m][:, lo : lo + BLOCK], code[m][step, lo : lo + BLOCK].astype(np.intp)
                            p = np.exp(p - p.max(axis=0))
                            p /= p.sum(axis=0)
                            pw = p * w[m][lo : lo + BLOCK]
                            for c in range(k):
                                sums[0, c] += np.bincount(at, pw[c], size[m][step])
                                sums[1, c] += np.bincount(at, pw[c] * (1 - p[c]), size[m][step])
                    for m, (p, h) in zip(mine, total(own), strict=True):
                        g, h = counts[m][step] * weight - p.T, h.T
                        g, h = _smooth(rng[m], g, h) if done < smoothing else (g, h)
                        new = rate * g / (h + 1.0)
                        scores[m][step] += new
                        for lo in range(0, len(w[m]) if m in w else 0, BLOCK):
                            at = code[m][step, lo : lo + BLOCK].astype(np.intp)
                            for c in range(k):
                                z[m][c, lo : lo + BLOCK] += new[:, c].take(at)
            if here.partitionId() == 0:
                lines = [(m, j, s.tobytes(), c.sum(axis=1).tobytes()) for m in group for j, (s, c) in enumerate(zip(scores[m], counts[m], strict=True))]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*lines, strict=True), (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["model", "place", "scores", "counts"])

        return task

    used = [m for m, own in enumerate(size) if own]
    counted = cells.where(F.col("model").isin(used)).groupBy("model", "cell").agg(*[F.count_if(F.col("y") == o).alias(f"n{i}") for i, o in enumerate(outputs)]).persist(StorageLevel.DISK_ONLY)
    try:
        number = {r["model"]: r["n"] for r in counted.groupBy("model").agg(F.count("*").alias("n")).collect()}
        groups, room = [], 0
        for m in used:
            need = number.get(m, 0) * (8 * (k + 1) + 2 * len(size[m]))
            if not groups or need > room:
                groups, room = [*groups, []], STATE * slots
            groups[-1].append(m)
            room -= need
        found = {}
        for group in groups:
            parts = max(1, min(slots, -(-sum(number.get(m, 0) for m in group) // TASK_CELLS)))
            dealt = counted.where(F.col("model").isin(group)).repartition(parts).sortWithinPartitions("model")
            lines = dealt.mapInArrow(run(group), "model int, place int, scores binary, counts binary", barrier=True)
            for r in lines.repartition(1).collect():  # only a stage before an exchange is run again if a task is lost
                found[r["model"], r["place"]] = np.frombuffer(r["scores"]).reshape(-1, k), np.frombuffer(r["counts"])
    finally:
        counted.unpersist()
    return [tuple([found[m, j][i] for j in range(len(own))] for i in (0, 1)) for m, own in enumerate(size)]


def _of_turn(path: str, turn: int) -> np.ndarray | None:
    """What a task's file has for a turn, None if that is not there as a whole."""
    try:
        with open(path, "rb") as f:
            raw = f.read()
    except FileNotFoundError:
        return None
    whole = len(raw) >= 16 and struct.unpack("<qq", raw[:16]) == (turn, zlib.crc32(raw[16:]))
    return np.frombuffer(raw, offset=16) if whole else None


def _steps_as_jobs(cells: DataFrame, size: list[list[int]], outputs: list[str], weight: np.ndarray, rounds: int, rate: float) -> list[tuple]:
    """``_steps_together`` by jobs: blocks of cells stay on the executors' disks; a job takes the scores so far and gives
    back each model's sums of gradients for the bins of its next feature."""
    k = len(outputs)
    code_of = {o: i for i, o in enumerate(outputs)}

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            model = batch.column(0).to_numpy()
            y = np.array([code_of[o] for o in batch.column(1).to_pylist()], dtype=np.int8 if k < 128 else np.int32)
            n = batch.column(3).to_numpy().astype(float)
            for m in np.unique(model):
                at = np.flatnonzero(model == m)
                cell = np.frombuffer(b"".join(batch.column(2).take(pa.array(at)).to_pylist()), np.int16).reshape(len(at), len(size[m]))
                yield pa.RecordBatch.from_arrays([pa.array([int(m)], pa.int32()), *[pa.array([v.tobytes()], pa.binary()) for v in (np.ascontiguousarray(cell.T), y[at], n[at])]], ["model", "cell", "y", "n"])

    # a block of all models' cells to a batch: few, large ones, or a step would wait for their number
    spark = cells.sparkSession
    size_before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BLOCK))
    try:
        parts = max(1, spark.sparkContext.defaultParallelism)
        counted = cells.groupBy("model", "y", "cell").agg(F.count("*").alias("n"))
        dealt = counted.repartition(parts).sortWithinPartitions("model").mapInArrow(blocks, "model int, cell binary, y binary, n binary")
        kept = dealt.rdd.map(lambda r: (r["model"], bytes(r["cell"]), bytes(r["y"]), bytes(r["n"]))).persist(StorageLevel.DISK_ONLY)
        kept.count()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size_before)
    kind = np.int8 if k < 128 else np.int32

    def sums(scores: list[list[np.ndarray]], step: int) -> list[np.ndarray | None]:
        """For each model with a feature of this place: gradients and their slopes, (2, bin, class)."""

        def run(part: Iterator[tuple]) -> Iterator[dict]:
            out: dict[int, np.ndarray] = {}
            for m, cell, y, n in part:
                if step >= len(size[m]):
                    continue
                n = np.frombuffer(n)
                code, y = np.frombuffer(cell, np.int16).reshape(len(size[m]), len(n)), np.frombuffer(y, kind)
                z = np.zeros((k, len(n)))
                for j, s in enumerate(scores[m]):
                    z += s.T[:, code[j]]
                z -= z.max(axis=0)
                np.exp(z, out=z)
                z /= z.sum(axis=0)
                w = weight[y] * n
                own = out.setdefault(m, np.zeros((2, size[m][step], k)))
                for c in range(k):
                    p = z[c]
                    own[0, :, c] += np.bincount(code[step], ((y == c) - p) * w, size[m][step])
                    own[1, :, c] += np.bincount(code[step], p * (1 - p) * w, size[m][step])
            yield out

        found: list[np.ndarray | None] = [None] * len(size)
        for out in kept.mapPartitions(run).collect():
            for m, own in out.items():
                found[m] = own if found[m] is None else found[m] + own
        return found

    try:
        scores = [[np.zeros((b, k)) for b in own] for own in size]
        count = kept.mapPartitions(lambda part: [_counted(part, size)]).reduce(lambda a, b: [[x + y for x, y in zip(*own, strict=True)] for own in zip(a, b, strict=True)])
        smoothing = min(50, rounds // 4)
        rng = [np.random.default_rng(0) for _ in size]
        for done in range(rounds):
            for step in range(max(map(len, size), default=0)):
                for m, own in enumerate(sums(scores, step)):
                    if own is not None:
                        g, h = _smooth(rng[m], *own) if done < smoothing else own
                        scores[m][step] += rate * g / (h + 1.0)
    finally:
        kept.unpersist()
    return list(zip(scores, count, strict=True))


def _counted(part: Iterator[tuple], size: list[list[int]]) -> list[list[np.ndarray]]:
    """The rows of each bin of each model's features in blocks of cells."""
    out = [[np.zeros(b) for b in own] for own in size]
    for m, cell, _, n in part:
        n = np.frombuffer(n)
        for j, code in enumerate(np.frombuffer(cell, np.int16).reshape(len(size[m]), len(n))):
            out[m][j] += np.bincount(code, n, size[m][j])
    return out


def fit(jobs: DataFrame, features: list[str], label: str, kind: str, rounds: int = ROUNDS, bins: int = BINS, sets: dict[str, list[str]] | None = None) -> DataFrame:
    """Terms of the models of all jobs: jobs has a row for each (model, text) with features and label. sets: jobs has a row for
    each text instead, which every model of sets has, on its own features.

    A model's rounds depend on each other. Up to TASK_VALUES values (a classifier up to a quarter of these, as each of its
    steps goes over all rows) a model is one task and jobs are what runs side by side; beyond, all tasks sum counts or
    gradients of bins. All do the same steps. Features of over PAIRED_BINS bins are one task a model at any size."""
    columns = [f"f{i}" for i in range(len(features))]  # a feature's own name may hold dots, which pandas functions don't take
    model = F.lit("") if sets is not None else F.col("model")
    rows = jobs.select(model.alias("model"), "text_id", label, *map(S.quoted, features)).toDF("model", "text_id", "label", *columns)
    most = max((r["n"] for r in rows.groupBy("model").agg(F.count("*").alias("n")).collect()), default=0) * len(features)
    if most > (TASK_VALUES if kind == "regressor" else TASK_VALUES // 4) and len(features) * (bins + 2) <= PAIRED_BINS:
        return _fit_counts(rows, columns, features, kind, rounds, bins, sets)
    if sets is not None:
        use = {c: [m for m, own in sets.items() if f in own] for c, f in zip(columns, features, strict=True)}
        rows = rows.withColumn("model", F.explode(F.array(*[F.lit(m) for m in sets])))
        rows = rows.withColumns({c: F.when(F.col("model").isin(m), F.col(c)) for c, m in use.items()})

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("text_id")
        names = sorted(map(str, pdf["label"].unique())) if kind == "classifier" else None
        y = pdf["label"].astype(str).to_numpy() if names else pdf["label"].to_numpy()
        usable = {c: f for c, f in zip(columns, features, strict=True) if pdf[c].notna().sum() >= 20 and pdf[c].nunique() > 1}
        out = fit_arrays(pdf[list(usable)].to_numpy(float), y, list(usable.values()), names, rounds, bins=bins)
        out.insert(0, "model", pdf["model"].iloc[0])
        return out

    return rows.groupBy("model").applyInPandas(one, TERMS)


def _fit_counts(rows: DataFrame, columns: list[str], features: list[str], kind: str, rounds: int, bins: int, sets: dict[str, list[str]] | None) -> DataFrame:
    """``fit`` for rows of (model, label, columns) that no single task holds."""
    spark = rows.sparkSession
    y = F.col("label").cast("double" if kind == "regressor" else "string")
    values = [F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c) for c in columns]
    rows = rows.select("model", y.alias("y"), *values).where("y is not null").persist(StorageLevel.DISK_ONLY)
    try:
        cuts: dict[tuple, list[tuple]] = {}
        for r in information.quantiles(relational.long_form(rows, columns, ["model"]), bins, ("model", "feature")).collect():
            cuts.setdefault((r["model"], r["feature"]), []).append((r["k"], r["cut"], r["n"]))
        every = []
        for (m,) in sorted(rows.select("model").distinct().collect()):
            mine = rows.where(F.col("model") == m)
            line = {c: sorted(cuts.get((m, c), [])) for c in columns}
            usable = [c for c in columns if line[c] and line[c][0][2] >= 20 and line[c][0][1] < line[c][-1][1]]
            names = [features[columns.index(c)] for c in usable]
            edges = [np.unique([x for _, x, _ in line[c][1:-1]]) for c in usable]
            models = {m: names} if sets is None else sets
            use = [[j for j, f in enumerate(names) if f in own] for own in models.values()]
            if kind == "classifier":
                classes = {r["y"]: r["n"] for r in mine.groupBy("y").agg(F.count("*").alias("n")).collect()}
                found = fit_steps(mine, usable, edges, names, use, classes, rounds)
            else:
                paired = _paired(mine, usable, edges)
                found = [fit_sums(paired, edges, names, own, rounds) for own in use]
            for name, out in zip(models, found, strict=True):
                out.insert(0, "model", name)
                every.append(out)
    finally:
        rows.unpersist()
    lines = pd.concat(every)
    return spark.createDataFrame([(r[0], r[1], int(r[2]), None if np.isnan(r[3]) else float(r[3]), r[4], float(r[5])) for r in lines.itertuples(index=False)], TERMS)


def contributions(rows: DataFrame, features: list[str], terms: DataFrame) -> DataFrame:
    """(text_id, model, feature, output, score): the exact parts of every text's scores, by lookup of each value's bin.

    Terms are a few hundred rows for each feature of a model; whether they are small enough to broadcast is left to adaptive
    execution, which knows their size. A value's bin is the last whose lower edge is at or below it."""
    steps = terms.where("feature <> ''").groupBy("model", "feature", "output").agg(F.array_sort(F.collect_list(F.struct("bin", "low", "score"))).alias("bins"))
    long = relational.long_form(rows, features, ["text_id"])
    hit = F.expr("if(value is null or isnan(value), bins[0].score, element_at(filter(bins, b -> b.bin > 0 and b.low <= value), -1).score)")
    return long.join(steps, "feature").select("text_id", "model", "feature", "output", hit.alias("score"))


def predict(rows: DataFrame, features: list[str], terms: DataFrame) -> DataFrame:
    """(text_id, model, output, score, probability): sums of intercept and contributions; probability by softmax over a
    model's outputs (1 for a regressor's one)."""
    base = terms.where("feature = ''").select("model", "output", F.col("score").alias("base"))
    total = contributions(rows, features, terms).groupBy("text_id", "model", "output").agg(F.sum("score").alias("s"))
    out = total.join(base, ["model", "output"]).select("text_id", "model", "output", (F.col("base") + F.col("s")).alias("score"))
    w = Window.partitionBy("text_id", "model")
    e = F.exp(F.col("score") - F.max("score").over(w))
    return out.withColumn("probability", e / F.sum(e).over(w))


def dummy(train: DataFrame, label: str, kind: str) -> DataFrame:
    """The terms of a baseline: the most frequent class (smallest of equals) or the median, as an intercept."""
    if kind == "regressor":
        top = train.agg(F.median(label).alias("score")).withColumn("output", F.lit("value"))
    else:
        counts = train.groupBy(F.col(label).cast("string").alias("output")).agg(F.count("*").alias("n"))
        top = counts.withColumn("score", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("n").desc(), "output")) == 1).cast("double"))
    return top.select(F.lit("baseline").alias("model"), F.lit("").alias("feature"), F.lit(0).alias("bin"), F.lit(None).cast("double").alias("low"), "output", F.col("score").cast("double").alias("score"))
