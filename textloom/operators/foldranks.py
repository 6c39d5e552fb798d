"""Rankings of features inside every fold of a cross-validation, from one pass over the texts.

A fold's training texts are all but its own. So counts of (feature, value, class) are made once, as arrays over the folds,
and a fold's training counts are the total less its own. Everything a ranking needs comes from these arrays, summed along a
feature's sorted values: within ranges of values, with the sums of the ranges before added from a row for each range.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.functions.ranges import range_of


def complement_counts(long: DataFrame, target: str, folds: int) -> DataFrame:
    """(feature, value, y, c): how many training texts each fold has of a value and a class, an array over the folds 0 to
    ``folds`` - 1. long: (feature, value, fold, target), nulls left out."""
    rows = long.where(F.col("value").isNotNull() & F.col(target).isNotNull() & F.col("fold").isNotNull())
    of = [F.count_if(F.col("fold") == k) for k in range(folds)]
    cells = rows.groupBy("feature", F.col("value").cast("double").alias("value"), F.col(target).cast("double").alias("y")).agg(F.count("*").alias("n"), F.array(*of).alias("own"))
    return cells.select("feature", "value", "y", F.expr("transform(own, x -> n - x)").alias("c"))


def _array_sum(c: str, folds: int) -> Column:
    return F.array(*[F.sum(F.get(c, F.lit(k))) for k in range(folds)])


def _ranged(cells: DataFrame, folds: int) -> tuple[DataFrame, DataFrame]:
    """(cells with their range, for each range and class: the sums of the ranges before and of all, and the least value of
    each fold after the range)."""
    ranged = cells.withColumn("part", range_of(F.col("value")))
    total = ranged.groupBy("feature", "part", "y").agg(_array_sum("c", folds).alias("c"))
    # every class has a row in every range, else a range's sums before it would be missing
    parts, classes = ranged.select("feature", "part").distinct(), ranged.select("feature", "y").distinct()
    zero = F.array(*[F.lit(0).cast("long")] * folds)
    total = parts.join(classes, "feature").join(total, ["feature", "part", "y"], "left").withColumn("c", F.coalesce("c", zero))
    line = Window.partitionBy("feature", "y").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy("feature", "y")
    over = lambda w: F.array(*[F.coalesce(F.sum(F.get("c", F.lit(k))).over(w), F.lit(0)) for k in range(folds)])
    sums = total.select("feature", "part", "y", over(line).alias("before"), over(every).alias("every"))
    # a value that only the fold's own texts have is none of its training texts
    least = ranged.groupBy("feature", "part").agg(*[F.min(F.when(F.get("c", F.lit(k)) > 0, F.col("value"))).alias(f"l{k}") for k in range(folds)])
    later = Window.partitionBy("feature").orderBy("part").rowsBetween(1, Window.unboundedFollowing)
    after = least.select("feature", "part", F.array(*[F.first(f"l{k}", ignorenulls=True).over(later) for k in range(folds)]).alias("after"))
    # names of their own: both sides come from the same counts
    return ranged, sums.join(after, ["feature", "part"]).select(F.col("feature").alias("of"), F.col("part").alias("at"), F.col("y").alias("y"), "before", "every", "after")


def _sides(cells: pd.DataFrame, sums: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(values, classes, counts of the values by fold and class, sums before): a range's values in order."""
    sums = sums.sort_values("y")
    y = sums["y"].to_numpy()
    before, every = (np.array(sums[c].tolist()).T for c in ("before", "every"))  # fold, class
    value, where = np.unique(cells["value"].to_numpy(), return_inverse=True)
    count = np.zeros((len(value), before.shape[0], len(y)))
    np.add.at(count, (where, slice(None), np.searchsorted(y, cells["y"].to_numpy())), np.array(cells["c"].tolist(), dtype=float))
    return value, y, count, np.stack([before, every]).astype(float)


def _entropy(c: np.ndarray) -> np.ndarray:
    """Bits of the class counts on the last axis."""
    n = c.sum(axis=-1)
    with np.errstate(divide="ignore", invalid="ignore"):
        part = np.where(c > 0, c * np.log2(c), 0).sum(axis=-1)
        return np.where(n > 0, np.log2(n) - part / n, 0.0)


GAINS = "feature string, fold int, gain double, threshold double"


def gains(long: DataFrame, target: str, folds: int, fraction: float = 0.005) -> DataFrame:
    """(feature, fold, gain, threshold): what ``information.information_gain`` gives for the training texts of each fold; a
    feature without a split has gain 0 and no threshold, one without training values in a fold no row."""
    ranged, sums = _ranged(complement_counts(long, target, folds), folds)

    def best(cells: pd.DataFrame, sums: pd.DataFrame) -> pd.DataFrame:
        value, _, count, (before, every) = _sides(cells, sums)
        after = np.array([np.nan if x is None else x for x in sums["after"].iloc[0]], dtype=float)
        left = before + np.cumsum(count, axis=0)
        some = count.sum(axis=2) > 0
        following = np.full(some.shape, np.nan)
        now = after
        for i in range(len(value) - 1, -1, -1):
            following[i] = now
            now = np.where(some[i], value[i], now)
        right = every - left
        nl, nr, n = left.sum(axis=2), right.sum(axis=2), every.sum(axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.round(_entropy(every) - nl / n * _entropy(left) - nr / n * _entropy(right), 12)
        least = np.maximum(2.0, np.ceil(fraction * n))
        ok = some & ~np.isnan(following) & (nl >= least) & (nr >= least) & (gain > 0)
        out = []
        for k in np.flatnonzero(n > 0):
            at = int(np.argmax(np.where(ok[:, k], gain[:, k], -1)))  # the lowest of equals
            fine = bool(ok[at, k])
            out.append((cells["feature"].iloc[0], int(k), float(gain[at, k]) if fine else 0.0, float((value[at] + following[at, k]) / 2) if fine else None))
        return pd.DataFrame(out, columns=["feature", "fold", "gain", "threshold"]).astype({"fold": "int32", "gain": float, "threshold": float})

    found = ranged.groupBy("feature", "part").cogroup(sums.groupBy("of", "at")).applyInPandas(best, GAINS)
    order = F.struct("gain", -F.coalesce(F.nanvl("threshold", F.lit(None).cast("double")), F.lit(float("inf"))))
    top = found.groupBy("feature", "fold").agg(F.max_by(F.struct("gain", "threshold"), order).alias("b"))
    return top.select("feature", "fold", "b.gain", F.nanvl("b.threshold", F.lit(None).cast("double")).alias("threshold"))


CUTS = "feature string, fold int, k int, high boolean, place double, value double, upto array<double>, below array<double>, every array<double>"


def informations(long: DataFrame, target: str, folds: int, bins: int = 20) -> DataFrame:
    """(feature, fold, mi): what ``information.binned_information`` gives for the training texts of each fold: values in bins
    between exact quantiles of the fold's training values, missing ones a bin of their own."""
    ranged, sums = _ranged(complement_counts(long, target, folds), folds)

    def cuts(cells: pd.DataFrame, sums: pd.DataFrame) -> pd.DataFrame:
        value, _, count, (before, every) = _sides(cells, sums)
        upto = before + np.cumsum(count, axis=0)
        size, last = count.sum(axis=2), upto.sum(axis=2)
        out = []
        for f in range(count.shape[1]):
            n = every[f].sum()
            if not n:
                continue
            for k in range(bins + 1):
                place = k / bins * (n - 1)
                for high, at in ((False, np.floor(place)), (True, np.ceil(place))):
                    i = int(np.searchsorted(last[:, f], at, side="right"))
                    if i < len(value) and at >= last[i, f] - size[i, f] and at >= before[f].sum():
                        out.append((cells["feature"].iloc[0], f, k, high, place, value[i], upto[i, f], upto[i, f] - count[i, f], every[f]))
        return pd.DataFrame(out, columns=["feature", "fold", "k", "high", "place", "value", "upto", "below", "every"])

    found = ranged.groupBy("feature", "part").cogroup(sums.groupBy("of", "at")).applyInPandas(cuts, CUTS)
    missing = long.where(F.col("value").isNull() & F.col(target).isNotNull() & F.col("fold").isNotNull()).groupBy("feature", F.col(target).cast("double").alias("y")).agg(F.count("*").alias("n"), F.array(*[F.count_if(F.col("fold") == k) for k in range(folds)]).alias("own"))
    missing = missing.groupBy("feature").agg(F.collect_list(F.struct("y", F.expr("transform(own, x -> n - x)").alias("c"))).alias("missing"))
    classes = ranged.groupBy("feature").agg(F.sort_array(F.collect_set("y")).alias("classes"))
    joined = found.join(classes, "feature").join(missing, "feature", "left")

    def information(pdf: pd.DataFrame) -> pd.DataFrame:
        f = int(pdf["fold"].iloc[0])
        low, top = (pdf[pdf["high"] == h].sort_values("k") for h in (False, True))
        every = np.asarray(pdf["every"].iloc[0])
        a, b, place = low["value"].to_numpy(), top["value"].to_numpy(), low["place"].to_numpy()
        with np.errstate(invalid="ignore"):
            cut = np.where(a == b, a, (np.ceil(place) - place) * a + (place - np.floor(place)) * b)
        below = np.where((cut <= a)[:, None], np.array(low["below"].tolist()), np.array(low["upto"].tolist()))  # counts of smaller values
        _, first = np.unique(cut, return_index=True)
        ends = below[first][1:-1]
        edges = np.concatenate([np.zeros((1, len(every))), ends, every[None]])
        table = list(np.diff(edges, axis=0))
        rows = pdf["missing"].iloc[0]
        known = {y: c for y, c in zip(pdf["classes"].iloc[0], np.array(table).T, strict=True)}
        none = {x["y"]: x["c"][f] for x in rows} if rows is not None else {}
        names = sorted({*known, *none})
        matrix = np.array([[*known.get(y, np.zeros(len(table))), float(none.get(y, 0))] for y in names])
        n = matrix.sum()
        with np.errstate(divide="ignore", invalid="ignore"):
            part = np.where(matrix > 0, matrix / n * np.log(matrix * n / (matrix.sum(axis=1, keepdims=True) * matrix.sum(axis=0))), 0)
        return pd.DataFrame({"feature": [pdf["feature"].iloc[0]], "fold": [f], "mi": [max(0.0, float(part.sum()))]})

    return joined.groupBy("feature", "fold").applyInPandas(information, "feature string, fold int, mi double")


def rankings(long: DataFrame, target: str, folds: int, k: int = 200) -> DataFrame:
    """(fold, feature, mi, ig, mi_rank, ig_rank, mi_selected, ig_selected): both rankings of the features inside each fold; ties
    go to the smaller name. A feature with values in no training text of a fold ranks last there with 0."""
    both = informations(long, target, folds).join(gains(long, target, folds).select("feature", "fold", F.col("gain").alias("ig")), ["feature", "fold"], "full_outer")
    both = both.fillna(0.0, ["mi", "ig"])
    rank = lambda c: F.row_number().over(Window.partitionBy("fold").orderBy(F.col(c).desc(), "feature"))
    out = both.withColumns({"mi_rank": rank("mi"), "ig_rank": rank("ig")})
    return out.select("fold", "feature", "mi", "ig", "mi_rank", "ig_rank", (F.col("mi_rank") <= k).alias("mi_selected"), (F.col("ig_rank") <= k).alias("ig_selected"))
