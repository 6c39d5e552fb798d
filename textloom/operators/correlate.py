"""Pearson and Spearman correlations in long form, with false-discovery control."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from textloom.functions import scalars as S
from textloom.functions.ranges import running
from textloom.sources import files


def pearson(x: Column, y: Column) -> Column:
    """Pearson's r over the rows where both are there, clamped to [-1, 1]; null instead of 0/0 for a constant."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    sd = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when(sd > 0, S.clamp(F.covar_pop(x, y) / F.when(sd > 0, sd), -1.0, 1.0))


def average_rank(value: str, *by: str) -> Column:
    """The average rank of ties within ``by``; never a window over all rows."""
    w = Window.partitionBy(*by).orderBy(value)
    return F.rank().over(w) + (F.count("*").over(Window.partitionBy(*by, value)) - 1) / 2.0


def correlations(long: DataFrame, target: str = "level") -> DataFrame:
    """(feature, n, pearson, spearman) of each feature with the target over the rows where the feature is there; the
    target is ranked anew on these rows.

    Ranks come from distinct values, summed over ranges of them: a window never holds more than the distinct values of
    one range of a feature, and ties need no pass of their own. The distinct values are written first, as the ranks are
    joined to them by value."""
    rows = long.where(F.col("value").isNotNull() & F.col(target).isNotNull())
    cells = files.settled(rows.groupBy("feature", "value", target).agg(F.count("*").alias("c")), "cells")

    def ranks(column: str) -> DataFrame:
        n = cells.groupBy("feature", column).agg(F.sum("c").alias("k"))
        return running(n, ["feature"], column, ["k"]).select("feature", column, (F.col("k_upto") - F.col("k") + (F.col("k") + 1) / 2.0).alias(f"rank_{column}"))

    ranked = cells.join(ranks("value"), ["feature", "value"]).join(ranks(target), ["feature", target])

    def weighted(x: str, y: str) -> Column:
        w = F.col("c").cast("double")
        a, b = F.col(x).cast("double"), F.col(y).cast("double")
        n, sx, sy = F.sum(w), F.sum(w * a), F.sum(w * b)
        cov, vx, vy = F.sum(w * a * b) - sx * sy / n, F.sum(w * a * a) - sx * sx / n, F.sum(w * b * b) - sy * sy / n
        both = F.sqrt(F.greatest(vx, F.lit(0.0))) * F.sqrt(F.greatest(vy, F.lit(0.0)))
        varies = (F.min(x) != F.max(x)) & (F.min(y) != F.max(y)) & (both > 0)
        return F.when(varies, S.clamp(cov / F.when(varies, both), -1.0, 1.0))

    return ranked.groupBy("feature").agg(F.sum("c").alias("n"), weighted("value", target).alias("pearson"), weighted("rank_value", f"rank_{target}").alias("spearman"))


@F.pandas_udf(T.DoubleType())
def normal_tail(z: pd.Series) -> pd.Series:
    """The two-sided p of a standard normal."""
    return z.map(lambda v: math.erfc(v / math.sqrt(2)), na_action="ignore")


def p_value(r: Column, n: Column) -> Column:
    """Fisher's two-sided p: null for n < 4, 0 for |r| = 1."""
    return F.when((n >= 4) & (F.abs(r) >= 1), F.lit(0.0)).otherwise(normal_tail(S.fisher_z(r, n)))


def benjamini_hochberg(tests: DataFrame, p: str = "p", q: str = "q", *by: str) -> DataFrame:
    """tests with q: the least p m / rank among equal or larger p, at most 1; a null p is no test. The tests are one row
    for each feature; m counts all of them, over all sources, unless ``by`` divides them."""
    group = [F.lit(0), *by]
    some = tests.where(F.col(p).isNotNull())
    m = F.count("*").over(Window.partitionBy(*group))
    rank = F.rank().over(Window.partitionBy(*group).orderBy(p)) + F.count("*").over(Window.partitionBy(*group, p)) - 1
    step = some.withColumn("_step", F.col(p) * m.cast("double") / rank.cast("double"))
    least = F.min("_step").over(Window.partitionBy(*group).orderBy(F.col(p).desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    done = step.withColumn(q, F.least(F.lit(1.0), least)).drop("_step")
    return done.unionByName(tests.where(F.col(p).isNull()).withColumn(q, F.lit(None).cast("double")))


def pair_correlations(long: DataFrame, key: str = "text_id") -> DataFrame:
    """(a, b, n, r) for features a < b over the texts that have both (one value for each text and feature).

    Every task sums its texts' values, less each feature's mean, into the matrices from which all pairs' correlations
    follow, and gives these: rows grow with the square of the features and the number of tasks, not with the texts. Features
    are few thousands; their names and means are literals of the plan."""
    rows = long.where("value is not null").select(key, "feature", F.col("value").cast("double").alias("value"))
    known = rows.groupBy("feature").agg(F.avg("value").alias("centre")).orderBy("feature").collect()
    names = [r["feature"] for r in known]
    place = rows.sparkSession.createDataFrame([(r["feature"], i, r["centre"]) for i, r in enumerate(known)], "feature string, i int, centre double")
    own = rows.join(F.broadcast(place), "feature").groupBy(key).agg(F.collect_list("i").alias("at"), F.collect_list(F.col("value") - F.col("centre")).alias("x"))
    size = len(names)

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sx, sxx, sxy = np.zeros((4, size, size))
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                row = np.repeat(np.arange(part.num_rows), part.column(0).value_lengths().to_numpy())
                x, there = np.zeros((2, part.num_rows, size))
                at = part.column(0).flatten().to_numpy()
                x[row, at] = part.column(1).flatten().to_numpy()
                there[row, at] = 1
                n += there.T @ there
                sx += x.T @ there
                sxx += (x * x).T @ there
                sxy += x.T @ x
        for i in range(size):
            j = np.flatnonzero(n[i] > 0)
            j = j[j > i]
            cols = [np.full(len(j), i), j, n[i, j], sx[i, j], sx[j, i], sxx[i, j], sxx[j, i], sxy[i, j]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["i", "j", "n", "sx", "sy", "sxx", "syy", "sxy"])

    sums = own.select("at", "x").mapInArrow(gram, "i long, j long, n double, sx double, sy double, sxx double, syy double, sxy double")
    total = sums.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])
    vx, vy = (F.col("n") * F.col(f"s{c}{c}") - F.col(f"s{c}") * F.col(f"s{c}") for c in "xy")
    varies = (vx > 1e-12 * F.col("n") * F.col("sxx")) & (vy > 1e-12 * F.col("n") * F.col("syy"))  # what rounding leaves of 0
    r = F.when(varies, S.clamp((F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / F.sqrt(F.when(varies, vx)) / F.sqrt(F.when(varies, vy)), -1.0, 1.0))
    name = F.array(*[F.lit(n) for n in names]) if names else F.array().cast("array<string>")
    return total.select(F.get(name, F.col("i").cast("int")).alias("a"), F.get(name, F.col("j").cast("int")).alias("b"), F.col("n").cast("long").alias("n"), r.alias("r"))


def rank_values(long: DataFrame) -> DataFrame:
    """long with value replaced by its average rank within the feature; nulls go. The rows are written first, as the ranks
    are joined to them by value."""
    rows = files.settled(long.where("value is not null"), "values")
    n = running(rows.groupBy("feature", "value").agg(F.count("*").alias("k")), ["feature"], "value", ["k"])
    rank = (F.col("k_upto") - F.col("k") + (F.col("k") + 1) / 2.0).alias("rank")
    return rows.join(n.select("feature", "value", rank), ["feature", "value"]).drop("value").withColumnRenamed("rank", "value")


def length_dependence(long: DataFrame, words: DataFrame, least: float = 0.3) -> DataFrame:
    """Features whose Spearman correlation with the words, within each level and averaged by the levels' sizes, is at
    least ``least`` in size: (feature, r)."""
    rows = long.where("value is not null").join(words.where("words is not null"), "text_id").withColumn("feature", F.concat_ws("|", "feature", "level"))
    own = correlations(rows.select("feature", "value", "words"), "words")
    own = own.withColumn("level", F.substring_index("feature", "|", -1)).withColumn("feature", F.substring_index("feature", "|", 1))
    out = own.where("spearman is not null").groupBy("feature").agg((F.sum(F.col("spearman") * F.col("n")) / F.sum("n")).alias("r"))
    return out.where(F.abs("r") >= least)


def prune_near_duplicates(pairs: DataFrame, order: list[str], least: float = 0.95) -> list[str]:
    """Of the features in ``order``, those that are not within ``least`` of one kept before; pairs are one row for each
    pair of features, of which only the close ones are collected."""
    close = {(r["a"], r["b"]) for r in pairs.where(F.abs("r") >= least).select("a", "b").collect()}
    kept: list[str] = []
    for f in order:
        if not any((f, k) in close or (k, f) in close for k in kept):
            kept.append(f)
    return kept
