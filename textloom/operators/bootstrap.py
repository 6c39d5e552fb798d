"""The learner bootstrap of a run: every metric of every model in each draw, from vectors over the draws.

A draw takes as many learners as there are, with replacement, and a learner brings all its texts. Tasks never make a row
for each learner and draw: a task turns the texts of its learners into one vector over the draws for each cell (a pair of
classes, a value, a sum), adds the vectors of its learners, and sends a vector for each cell. Vectors add up, so they are
merged like any sum. Metrics come from a model's merged vectors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Learners of a block, blocks at most, learners of a block that are drawn at once, rows of texts that are added at once.
BLOCK, BLOCKS, MEMBERS, ROWS = 1024, 65_536, 512, 512
#: Bytes of vectors that a task gathers before it sends them.
HELD = 64 << 20
CLASS_METRICS = ["accuracy", "macro_f1", "ordinal_mae", "within_one", "qwk"]
SUMS = ["n", "absolute", "squared", "truth", "truth_squared"]


class Multinomial:
    """How often each draw has each learner: an exact multinomial draw of as many learners as there are.

    sizes: learners of each block. How many of a draw fall to a block comes from halving the blocks again and again, each
    time by a binomial draw of a generator of its own, so a task draws log2(blocks) numbers for a block, not all blocks'."""

    def __init__(self, sizes: np.ndarray, draws: int = 2000, seed: int = 42):
        self.before, self.draws, self.seed = np.concatenate([[0], np.cumsum(sizes)]), draws, seed

    def share(self, block: int) -> np.ndarray:
        lo, hi = 0, len(self.before) - 1
        n = np.full(self.draws, self.before[-1], dtype=np.int64)
        while hi - lo > 1:
            mid = (lo + hi) // 2
            whole, left = self.before[hi] - self.before[lo], self.before[mid] - self.before[lo]
            drawn = np.random.default_rng([self.seed, lo, hi]).binomial(n, left / whole if whole else 0.0)
            lo, hi, n = (lo, mid, drawn) if block < mid else (mid, hi, n - drawn)
        return n

    def of(self, block: int, ids: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(first member, weights of members by draws) of a block's members, MEMBERS at a time. ids are not looked at."""
        left, size = self.share(block), int(self.before[block + 1] - self.before[block])
        rng = np.random.default_rng([self.seed, block, block, 1])
        for lo in range(0, size, MEMBERS):
            m = min(MEMBERS, size - lo)
            own = rng.binomial(left, m / (size - lo))
            yield lo, rng.multinomial(own, np.full(m, 1 / m)).T
            left = left - own


class Given:
    """Weights by a rule: ``weights(ids, draws)`` gives an array of ids by draws. For draws that are known from elsewhere."""

    def __init__(self, weights: Callable[[np.ndarray, np.ndarray], np.ndarray], draws: int):
        self.weights, self.draws = weights, draws

    def of(self, block: int, ids: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        for lo in range(0, len(ids), MEMBERS):
            yield lo, self.weights(ids[lo : lo + MEMBERS], np.arange(self.draws))


def blocks_of(learners: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """((block, members: sorted ids, of: how many blocks), learners of each block) of the distinct ids; blocks are dealt by a hash."""
    ids = learners.select(F.col("learner_id").cast("long").alias("learner_id")).where("learner_id is not null").distinct()
    count = min(BLOCKS, max(1, -(-ids.count() // BLOCK)))
    own = ids.groupBy(F.pmod(F.xxhash64("learner_id"), F.lit(count)).cast("int").alias("block")).agg(F.array_sort(F.collect_list("learner_id")).alias("members"), F.lit(count).alias("of"))
    sizes = np.zeros(count, dtype=np.int64)
    for r in own.select("block", F.size("members").alias("n")).collect():  # a number for each block, BLOCKS at most
        sizes[r["block"]] = r["n"]
    return own, sizes


def vectors(rows: DataFrame, blocks: DataFrame, weights: Multinomial | Given, by: list[str], values: list[str]) -> DataFrame:
    """(by, v): for each cell of ``by`` (columns of string, whole or real numbers) the sums of the values times the learners'
    weights in all draws: doubles, one draw after the other for each value, as bytes. A cell has a row of each task at most few."""
    cells = rows.groupBy("learner_id", *by).agg(*[F.sum(F.col(c).cast("double")).alias(f"_{k}") for k, c in enumerate(values)])
    some = blocks.first()  # a block may have no learner, so they say how many there are
    count = some["of"] if some else 1
    cells = cells.withColumn("block", F.pmod(F.xxhash64(F.col("learner_id").cast("long")), F.lit(count)).cast("int"))
    members = blocks.select("block", "members").withColumn("kind", F.lit(0))
    # a block's members come first, then the cells of its learners
    none = [F.lit(None).cast(cells.schema[c].dataType).alias(c) for c in ["learner_id", *by, *[f"_{k}" for k in range(len(values))]]]
    dealt = members.select("block", "kind", "members", *none).unionByName(cells.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    dealt = dealt.repartition("block").sortWithinPartitions("block", "kind")
    fields = pa.schema([(c, pa.string() if t == "string" else pa.float64() if t in ("double", "float") else pa.int64()) for c, t in rows.select(*by).dtypes] + [("v", pa.binary())])
    width = len(values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        block, ids, parts = None, np.zeros(0, np.int64), []

        def add() -> None:
            own = pd.concat([p.to_pandas() for p in parts])
            place = np.searchsorted(ids, own["learner_id"].to_numpy(np.int64))
            keys = own[by].apply(lambda c: c.astype(object).where(c.notna(), None)) if by else own[[]]
            code, names = pd.factorize(pd.Series(list(map(tuple, keys.to_numpy())), dtype=object)) if by else (np.zeros(len(own), int), [()])
            amount = own[[f"_{k}" for k in range(width)]].to_numpy(float)
            for lo, w in weights.of(block, ids):
                these = np.flatnonzero((place >= lo) & (place < lo + len(w)))
                these = these[np.argsort(code[these], kind="stable")]
                for at in range(0, len(these), ROWS):
                    some = these[at : at + ROWS]
                    first = np.flatnonzero(np.concatenate([[True], code[some][1:] != code[some][:-1]]))
                    drawn = w[place[some] - lo].astype(np.float64)
                    sums = np.concatenate([np.add.reduceat(drawn * amount[some, k : k + 1], first, axis=0) for k in range(width)], axis=1)
                    for c, s in zip(code[some][first], sums, strict=True):
                        name = names[c]
                        held[name] = held[name] + s if name in held else s

        def sent() -> Iterator[pa.RecordBatch]:
            names = list(held)
            cols = [pa.array([n[k] for n in names], fields.field(k).type) for k in range(len(by))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([held[n].tobytes() for n in names], pa.binary())], schema=fields)
            held.clear()

        for batch in batches:
            table = pa.Table.from_batches([batch])
            number = table.column("block").to_numpy()
            cuts = [0, *(np.flatnonzero(number[1:] != number[:-1]) + 1), len(number)]
            for a, z in zip(cuts, cuts[1:], strict=False):
                if a == z:
                    continue
                part = table.slice(a, z - a)
                if number[a] != block:
                    if parts:
                        add()
                    block, parts = int(number[a]), []
                    ids = np.array(part.column("members")[0].as_py())
                    part = part.slice(1)
                if part.num_rows:
                    parts.append(part.drop_columns(["members"]))
            if len(held) * weights.draws * width * 8 > HELD:
                yield from sent()
        if parts:
            add()
        if held:
            yield from sent()

    schema = ", ".join([f"`{f.name}` {'string' if f.type == pa.string() else 'double' if f.type == pa.float64() else 'long'}" for f in fields][:-1] + ["v binary"])
    return dealt.mapInArrow(run, schema)


def merged(cells: DataFrame, by: list[str]) -> DataFrame:
    """Cells with one vector each, the sum of the tasks' vectors."""

    def total(table: pa.Table) -> pa.Table:
        v = np.sum([np.frombuffer(x.as_py()) for x in table.column("v")], axis=0)
        return table.slice(0, 1).set_column(table.schema.get_field_index("v"), "v", pa.array([v.tobytes()], pa.binary()))

    return cells.groupBy(*by).applyInArrow(total, cells.schema)


def class_metrics(confusion: np.ndarray) -> dict[str, np.ndarray]:
    """CLASS_METRICS of stacked confusion matrices (draw, actual, predicted); NaN where undefined, F1 0 where it is."""
    place = np.arange(confusion.shape[1])
    gap = np.abs(place[:, None] - place).astype(float)
    n, actual, guess, hit = confusion.sum(axis=(1, 2)), confusion.sum(axis=2), confusion.sum(axis=1), confusion[:, place, place]
    with np.errstate(divide="ignore", invalid="ignore"):
        chance = np.einsum("di,dj,ij->d", actual, guess, gap**2) / n
        out = [hit.sum(axis=1) / n, np.where(actual + guess > 0, 2 * hit / (actual + guess), 0).mean(axis=1), (confusion * gap).sum(axis=(1, 2)) / n]
        out += [(confusion * (gap <= 1)).sum(axis=(1, 2)) / n, np.where(chance > 0, 1 - (confusion * gap**2).sum(axis=(1, 2)) / chance, np.nan)]
    return dict(zip(CLASS_METRICS, out, strict=True))


def regression_metrics(sums: np.ndarray) -> dict[str, np.ndarray]:
    """mae, rmse and r2 of SUMS by draws; r2 NaN where the truth doesn't vary."""
    n, absolute, squared, truth, truth_squared = sums
    with np.errstate(divide="ignore", invalid="ignore"):
        spread = truth_squared - truth * truth / n
        return {"mae": absolute / n, "rmse": np.sqrt(squared / n), "r2": np.where(spread > 1e-9, 1 - squared / spread, np.nan)}


METRICS = "draw int, metric string, value double"


def _metric_table(keys: dict, found: dict[str, np.ndarray]) -> pa.Table:
    draws = len(next(iter(found.values())))
    cols = {k: pa.array([v] * draws * len(found)) for k, v in keys.items()}
    cols |= {"draw": pa.array(np.tile(np.arange(draws, dtype=np.int32), len(found))), "metric": pa.array(np.repeat(list(found), draws).astype(object), pa.string())}
    value = np.concatenate(list(found.values()))
    return pa.table({**cols, "value": pa.array(value, mask=~np.isfinite(value))})


def class_draws(rows: DataFrame, blocks: DataFrame, weights: Multinomial | Given, actual: str, predicted: str, labels: list) -> DataFrame:
    """(model, draw, metric, value): CLASS_METRICS of each model in each draw. rows: (model, learner_id, actual, predicted)."""
    own = rows.select("model", "learner_id", F.col(actual).cast("string").alias("actual"), F.col(predicted).cast("string").alias("predicted"), F.lit(1).alias("one"))
    by = ["model", "actual", "predicted"]
    at = {str(x): k for k, x in enumerate(labels)}

    def score(table: pa.Table) -> pa.Table:
        matrix = np.zeros((len(at), len(at), weights.draws))
        for a, p, v in zip(*(table.column(c).to_pylist() for c in ("actual", "predicted", "v")), strict=True):
            matrix[at[a], at[p]] += np.frombuffer(v)
        return _metric_table({"model": table.column("model")[0].as_py()}, class_metrics(matrix.transpose(2, 0, 1)))

    return merged(vectors(own, blocks, weights, by, ["one"]), by).groupBy("model").applyInArrow(score, "model string, " + METRICS)


def regression_draws(rows: DataFrame, blocks: DataFrame, weights: Multinomial | Given, actual: str, predicted: str) -> DataFrame:
    """(model, draw, metric, value): mae, rmse and r2 of each model in each draw."""
    y, d = F.col(actual).cast("double"), F.col(predicted).cast("double") - F.col(actual).cast("double")
    own = rows.select("model", "learner_id", F.lit(1).alias("n"), F.abs(d).alias("absolute"), (d * d).alias("squared"), y.alias("truth"), (y * y).alias("truth_squared"))

    def score(table: pa.Table) -> pa.Table:
        v = np.sum([np.frombuffer(x.as_py()) for x in table.column("v")], axis=0)
        return _metric_table({"model": table.column("model")[0].as_py()}, regression_metrics(v.reshape(len(SUMS), -1)))

    return vectors(own, blocks, weights, ["model"], SUMS).groupBy("model").applyInArrow(score, "model string, " + METRICS)


def rank_draws(rows: DataFrame, blocks: DataFrame, weights: Multinomial | Given, actual: str, predicted: str) -> DataFrame:
    """(model, draw, metric, value): Spearman's correlation of each model in each draw, ties at their mean rank; null where one
    side doesn't vary. actual: whole numbers of few values.

    The values of a model are dealt to sorted ranges. A range ranks its own values in all draws, from 0 on, and sends sums for
    each actual value; the ranks before a range are added to these sums afterwards."""
    x, y = F.col(predicted).cast("double").alias("x"), F.col(actual).cast("long").alias("y")
    cells = merged(vectors(rows.select("model", "learner_id", x, y, F.lit(1).alias("one")), blocks, weights, ["model", "x", "y"], ["one"]), ["model", "x", "y"])
    dealt = cells.repartitionByRange("model", "x").sortWithinPartitions("model", "x")
    draws = weights.draws

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, begin, upto, found, run = None, 0.0, np.zeros(draws), {}, []

        def done() -> None:
            """Ranks the cells of one value."""
            nonlocal upto
            n = np.sum([v for _, v in run], axis=0)
            rank = upto + (n + 1) / 2
            for k, v in run:
                own = found.setdefault(k, np.zeros((3, draws)))
                own += [v, v * rank, v * rank * rank]
            upto = upto + n

        def sent() -> Iterator[pa.RecordBatch]:
            if run:
                done()
            if found:
                cols = [pa.array([model] * len(found)), pa.array([begin] * len(found)), pa.array(list(found), pa.int64()), pa.array([v.tobytes() for v in found.values()], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["model", "begin", "y", "v"])

        value = None
        for batch in batches:
            for m, x, k, v in zip(*(batch.column(c) for c in range(4)), strict=True):
                m, x, k, v = m.as_py(), x.as_py(), k.as_py(), np.frombuffer(v.as_py())
                if m != model:
                    yield from sent()
                    model, begin, upto, found, run, value = m, x, np.zeros(draws), {}, [], None
                if x != value and run:
                    done()
                    run = []
                value = x
                run.append((k, v))
        yield from sent()

    def whole(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("begin", "y", "v")), strict=True), key=lambda r: (r[0], r[1]))
        total, upto, at = {}, np.zeros(draws), None
        before = upto
        for begin, k, v in rows:
            n, ranked, squared = np.frombuffer(v).reshape(3, -1)
            if begin != at:
                at, before = begin, upto
            own = total.setdefault(k, np.zeros((3, draws)))
            own += [n, ranked + before * n, squared + 2 * before * ranked + before * before * n]
            upto = upto + n
        n, rank, seen = upto, {}, np.zeros(draws)
        for k in sorted(total):
            rank[k] = seen + (total[k][0] + 1) / 2
            seen = seen + total[k][0]
        mean = (n + 1) / 2
        with np.errstate(divide="ignore", invalid="ignore"):
            xx = sum(t[2] for t in total.values()) - n * mean * mean
            yy = sum(t[0] * rank[k] ** 2 for k, t in total.items()) - n * mean * mean
            xy = sum(t[1] * rank[k] for k, t in total.items()) - n * mean * mean
            r = np.where((xx > 1e-9) & (yy > 1e-9), xy / np.sqrt(xx * yy), np.nan)
        return _metric_table({"model": table.column("model")[0].as_py()}, {"spearman": r})

    parts = dealt.select("model", "x", "y", "v").mapInArrow(ranges, "model string, begin double, y long, v binary")
    return parts.groupBy("model").applyInArrow(whole, "model string, " + METRICS)


def run_draws(rows: DataFrame, kind: str, actual: str, predicted: str, labels: list | None = None, draws: int = 2000, seed: int = 42, weights: Given | None = None) -> DataFrame:
    """(model, draw, metric, value) of rows (model, learner_id, actual, predicted): CLASS_METRICS of a classifier; mae, rmse, r2
    and spearman of a regressor. All models see the same draws. weights: given draws instead of multinomial ones.

    Texts without a learner are in no draw; an undefined metric is null; without rows there are none."""
    blocks, sizes = blocks_of(rows)
    weights = weights or Multinomial(sizes, draws, seed)
    rows = rows.where("learner_id is not null")
    if kind == "classifier":
        return class_draws(rows, blocks, weights, actual, predicted, labels)
    return regression_draws(rows, blocks, weights, actual, predicted).unionAll(rank_draws(rows, blocks, weights, actual, predicted))
