"""Entropy, information gain and mutual information of features about a class."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from textloom.functions import scalars as S
from textloom.functions.ranges import following, neighbours, running


def entropy(df: DataFrame, target: str) -> DataFrame:
    """(entropy) in nats of the target's non-null values."""
    n = df.where(F.col(target).isNotNull()).groupBy(target).agg(F.count("*").alias("c"))
    total = F.sum("c")
    return n.agg((F.log(total.cast("double")) - F.sum(F.col("c") * F.log(F.col("c").cast("double"))) / total).alias("entropy"))


def _h(n: Column, xlogx: Column) -> Column:
    """Entropy in bits of counts that sum to n, given their sum of c log2 c."""
    return F.when(n > 0, F.log2(n.cast("double")) - xlogx / n).otherwise(F.lit(0.0))


def information_gain(long: DataFrame, target: str = "level", fraction: float = 0.005) -> DataFrame:
    """(feature, n, gain, normalised, threshold, low_mean, high_mean) of the best binary split of each feature, by
    entropy in bits; both sides hold at least max(2, ceil(fraction n)) rows; ties go to the lowest threshold.

    Values first become distinct values with a count for each class; cumulative counts, summed over ranges of values, give
    both sides of every split. There are as many rows as distinct values; classes are few and their names are read first."""
    rows = long.where(F.col("value").isNotNull() & F.col(target).isNotNull()).withColumn("y", F.col(target).cast("double"))
    classes = [r["y"] for r in rows.select("y").distinct().orderBy("y").collect()]
    at = range(len(classes))
    cell = rows.groupBy("feature", "value").agg(*[F.count_if(F.col("y") == y).alias(f"c{i}") for i, y in enumerate(classes)])
    grid = running(cell, ["feature"], "value", [f"c{i}" for i in at])
    left, whole = [F.col(f"c{i}_upto") for i in at], [F.col(f"c{i}_all") for i in at]
    right = [t - l for l, t in zip(left, whole, strict=True)]
    total = lambda parts: sum(parts, F.lit(0))
    xlx = lambda parts: sum((F.when(c > 0, c * F.log2(c.cast("double"))).otherwise(F.lit(0.0)) for c in parts), F.lit(0.0))
    sides = {"l": left, "t": whole, "r": right}
    side = grid.select("feature", "value", *[total(c).alias(f"n{k}") for k, c in sides.items()], *[xlx(c).alias(f"x{k}") for k, c in sides.items()], *[sum((c * y for c, y in zip(sides[k], classes, strict=True)), F.lit(0.0)).alias(f"s{k}") for k in "lr"])
    side = following(side, ["feature"], "value", "next")
    n = F.col("nt").cast("double")
    side = side.withColumn("h", _h(F.col("nt"), F.col("xt")))
    gain = F.col("h") - F.col("nl") / n * _h(F.col("nl"), F.col("xl")) - F.col("nr") / n * _h(F.col("nr"), F.col("xr"))
    least = F.greatest(F.lit(2.0), F.ceil(F.lit(fraction) * n))
    side = side.withColumn("gain", F.greatest(F.lit(0.0), F.round(gain, 12))).withColumn("threshold", (F.col("value") + F.col("next")) / 2)
    split = side.where(F.col("next").isNotNull() & (F.col("nl") >= least) & (F.col("nr") >= least) & (F.col("gain") > 0))
    first = F.struct("gain", -F.col("threshold"))
    best = split.groupBy("feature").agg(F.max_by(F.struct(*split.columns[1:]), first).alias("b")).select("feature", "b.*")
    best = best.select("feature", "gain", F.when(F.col("h") > 0, F.col("gain") / F.col("h")).alias("normalised"), "threshold", (F.col("sl") / F.col("nl")).alias("low_mean"), (F.col("sr") / F.col("nr")).alias("high_mean"))
    every = rows.groupBy("feature").agg(F.count("*").alias("n"))
    return every.join(best, "feature", "left").fillna(0.0, ["gain", "normalised"])


def quantiles(long: DataFrame, bins: int, by: tuple[str, ...] = ("feature",)) -> DataFrame:
    """(by, n, k, cut): the exact quantiles k / bins, k from 0 to bins, of each group's values, found by running counts over
    ranges of its distinct values; n values are there."""
    cells = long.where("value is not null").groupBy(*by, F.col("value").cast("double").alias("value")).agg(F.count("*").alias("c"))
    cells = running(cells, [*by], "value", ["c"])
    # the k-th of bins cuts lies at place k / bins (n - 1) of the sorted values, between two of them
    place = lambda k: k.cast("double") / bins * (F.col("c_all") - 1)
    last = F.greatest(F.col("c_all") - 1, F.lit(1))
    # only cuts near a value's places are looked at, and of these kept that touch it
    near = F.sequence(F.greatest(F.floor((F.col("c_upto") - F.col("c") - 1) * bins / last) - 1, F.lit(0)), F.least(F.ceil(F.col("c_upto") * bins / last) + 1, F.lit(bins)))
    touches = lambda at: (at < F.col("c_upto")) & (at >= F.col("c_upto") - F.col("c"))
    mine = F.filter(F.when(F.col("c_all") > 1, near).otherwise(F.sequence(F.lit(0).cast("long"), F.lit(bins).cast("long"))), lambda k: touches(F.floor(place(k))) | touches(F.ceil(place(k))))
    found = cells.select(*by, "value", "c_all", F.explode(mine).alias("k")).groupBy(*by, "k").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.first("c_all").alias("n"))
    at = F.col("k").cast("double") / bins * (F.col("n") - 1)
    cut = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise((F.ceil(at) - at) * F.col("low") + (at - F.floor(at)) * F.col("high"))
    return found.select(*by, "n", F.col("k").cast("int").alias("k"), cut.alias("cut"))


def quantile_bins(long: DataFrame, bins: int = 20) -> DataFrame:
    """long with ``bin``: 0 for a null value, else 1 plus the number of distinct quantile edges at or below the value. The
    edges are exact quantiles, a few for each feature, which every task gets."""
    edges = quantiles(long, bins).groupBy("feature").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("k", "cut"))), lambda x: x["cut"])).alias("edges"))
    inner = F.slice("edges", 2, F.greatest(F.size("edges") - 2, F.lit(0)))
    joined = long.join(F.broadcast(edges), "feature", "left")
    count = F.size(F.filter(F.coalesce(inner, F.array().cast("array<double>")), lambda e: e <= F.col("value"))) + 1
    return joined.withColumn("bin", F.when(F.col("value").isNull(), 0).otherwise(count)).drop("edges")


def binned_information(long: DataFrame, target: str = "level", bins: int = 20) -> DataFrame:
    """(feature, mi): mutual information in nats of the binned values, missing ones as a bin, and the target."""
    cell = quantile_bins(long, bins).where(F.col(target).isNotNull()).groupBy("feature", "bin", target).agg(F.count("*").alias("c"))
    n, x, y = (F.sum("c").over(Window.partitionBy("feature", *more)).cast("double") for more in ([], ["bin"], [target]))
    part = cell.withColumn("m", F.col("c") / n * F.log(F.col("c") * n / (x * y)))
    return part.groupBy("feature").agg(F.greatest(F.lit(0.0), F.sum("m")).alias("mi"))


def _psi(n: Column) -> Column:
    """Digamma of a whole number of 1 or more: its sum below 20, then its series, to about 1e-13."""
    small = F.array(*[F.lit(sum(1 / i for i in range(1, m)) - 0.5772156649015329) for m in range(1, 20)])
    x = n.cast("double")
    series = F.log(x) - 1 / (2 * x) - 1 / (12 * x**2) + 1 / (120 * x**4) - 1 / (252 * x**6)
    return F.when(n < 20, F.get(small, (n - 1).cast("int"))).otherwise(series)


def _ordered(x: np.ndarray) -> np.ndarray:
    """Doubles as whole numbers of the same order, and back (as their bits)."""
    bits = x.view(np.int64)
    return bits ^ (bits >> 63 & 0x7FFFFFFFFFFFFFFF)


@F.pandas_udf(T.StructType([T.StructField("low", T.DoubleType()), T.StructField("high", T.DoubleType())]))
def _reach(value: pd.Series, distance: pd.Series) -> pd.DataFrame:
    """The least and greatest double less than distance from value by a rounded difference (value itself for 0), by
    bisection of all doubles: value +- distance alone would round."""
    x, d = value.to_numpy(float), distance.to_numpy(float)
    out = []
    for sign in (-1.0, 1.0):
        y = sign * x + 0.0
        inside, outside = _ordered(y), _ordered(np.full(len(y), np.inf))
        while (outside - inside != 1).any():
            mid = (inside & outside) + ((inside ^ outside) >> 1)
            near = _ordered(mid).view(float) - y < d
            inside, outside = np.where(near, mid, inside), np.where(near, outside, np.maximum(mid, inside + 1))
        out.append(np.where(d > 0, sign * _ordered(inside).view(float) + 0.0, x))
    return pd.DataFrame({"low": out[0], "high": out[1]})


def neighbour_information(long: DataFrame, target: str = "level", k: int = 3) -> DataFrame:
    """(feature, n, mi, normalised) by Ross's nearest-neighbour estimator of a continuous value and a class, in nats,
    at least 0, normalised by the class's entropy and at most 1; constants score 0.

    All rows count, at every size: they become distinct (value, class) counts, windows over ranges of values and over the ends of
    ranges give each the distance of its k-th neighbour in its class, and a running count over a feature's distinct values and ends of neighbourhoods how many rows
    lie nearer. Classes of one row are left out as the estimator asks. Equal values are distances 0."""
    rows = long.where(F.col("value").isNotNull() & F.col(target).isNotNull())
    cell = rows.groupBy("feature", F.col("value").cast("double").alias("value"), F.col(target).alias("y")).agg(F.count("*").alias("c"))
    size = cell.groupBy("feature", "y").agg(F.sum("c").alias("size"), F.min("value").alias("low"), F.max("value").alias("high"))
    n = F.sum("size").cast("double")
    whole = size.groupBy("feature").agg(
        F.sum("size").alias("n"), (F.log(n) - F.sum(F.col("size") * F.log(F.col("size").cast("double"))) / n).alias("h"), (F.min("low") < F.max("high")).alias("varies")
    )
    used = neighbours(cell, ["feature", "y"], "value", "c", k).join(size.select("feature", "y", "size"), ["feature", "y"]).where("size >= 2")
    near = F.concat(F.array(F.struct(F.lit(0.0).alias("d"), (F.col("c") - 1).alias("c"))), "near")
    used = used.withColumn("kk", F.least(F.lit(k).cast("long"), F.col("size") - 1)).withColumn("near", F.array_sort(near))
    reached = """aggregate(near, named_struct('seen', 0L, 'd', cast(null as double)), (a, x) -> named_struct('seen', a.seen + x.c,
        'd', if(a.seen < kk and a.seen + x.c >= kk, x.d, a.d)), a -> a.d)"""
    used = used.select("feature", "y", "value", "c", "size", "kk", _reach("value", F.expr(reached)).alias("r"))
    ends = F.explode(F.array(*[F.struct(key.alias("key"), F.lit(kind).alias("kind")) for kind, key in enumerate((F.col("r.low"), F.col("value"), F.col("r.high")))]))
    events = used.select("feature", "y", "value", "c", "size", "kk", ends.alias("e")).select("*", "e.key", "e.kind")
    events = events.withColumn("own", F.when(F.col("kind") == 1, F.col("c")).otherwise(F.lit(0)))
    events = running(events, ["feature"], "key", ["own"], ["kind"]).withColumnRenamed("own_upto", "below")
    # the count up to a neighbourhood's end less the one before it
    inside = F.sum(F.when(F.col("kind") == 2, F.col("below")).otherwise(-F.col("below"))).alias("m")
    m = events.where("kind <> 1").groupBy("feature", "y", "value", "c", "size", "kk").agg(inside)
    part = F.col("c") * (_psi(F.col("kk")) - _psi(F.col("size")) - _psi(F.greatest(F.col("m"), F.lit(1))))
    total = m.groupBy("feature").agg(F.sum("c").alias("of"), F.sum(part).alias("parts"))
    mi = F.when(F.col("varies") & (F.col("of") > 0), F.greatest(F.lit(0.0), _psi(F.col("of")) + F.col("parts") / F.col("of"))).otherwise(F.lit(0.0))
    out = whole.join(total, "feature", "left").select("feature", "n", mi.alias("mi"), "h")
    return out.select("feature", "n", "mi", F.when(F.col("h") > 0, F.least(F.lit(1.0), F.col("mi") / F.col("h"))).otherwise(F.lit(0.0)).alias("normalised"))


def tolerant_rank(scores: DataFrame, score: str = "score") -> DataFrame:
    """scores with rank: of equal scores the same, where a score is equal to the first of its run if it is within 1e-9 of
    it in proportion or 1e-15 in size. A fold over the distinct scores, best first, of which there are
    no more than features."""
    line = F.array_sort(F.collect_list(F.struct((-F.col(score)).alias("s"), "k")))
    near = "coalesce(abs(x.s - a.top) <= greatest(1e-9D * greatest(abs(x.s), abs(a.top)), 1e-15D), false)"
    ranks = F.expr(
        f"""aggregate(line, named_struct('top', cast(null as double), 'rank', 0L, 'n', 0L, 'out', cast(array() as array<struct<s: double, rank: bigint>>)),
              (a, x) -> named_struct('top', if({near}, a.top, x.s), 'rank', if({near}, a.rank, a.n + 1), 'n', a.n + x.k,
                'out', concat(a.out, array(named_struct('s', x.s, 'rank', if({near}, a.rank, a.n + 1))))), a -> a.out)"""
    )
    found = scores.groupBy(score).agg(F.count("*").alias("k")).agg(line.alias("line")).select(F.explode(ranks).alias("r"))
    return scores.join(found.select((-F.col("r.s")).alias(score), F.col("r.rank").cast("int").alias("rank")), score)


def ranking(mi: DataFrame, ig: DataFrame, k: int = 200) -> DataFrame:
    """(feature, mi, ig, mi_rank, ig_rank, selected): both rankings beside each other, which must rank the same features."""
    both = mi.select("feature", "mi").join(ig.select("feature", F.col("gain").alias("ig")), "feature", "full_outer")
    every = Window.partitionBy(F.lit(0))
    out = both.withColumn("mi_rank", F.row_number().over(every.orderBy(F.col("mi").desc_nulls_last(), "feature"))).withColumn("ig_rank", F.row_number().over(every.orderBy(F.col("ig").desc_nulls_last(), "feature")))
    return out.withColumn("selected", S.selection(F.col("mi_rank") <= k, F.col("ig_rank") <= k))
