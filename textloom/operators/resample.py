"""Learner-wise splits, folds and the learner-cluster bootstrap."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.functions import scalars as S
from textloom.operators import bootstrap


def with_split(texts: DataFrame, learner: str = "learner_id") -> DataFrame:
    """texts with split by a hash of the learner: 70 % train, 15 % validation, 15 % test."""
    return texts.withColumn("split", S.split_of(F.col(learner)))


def split_problems(texts: DataFrame, label: str = "cefr_level") -> DataFrame:
    """(problem, n) with n > 0 only where a learner is in two splits, or a split has a label with under two texts."""
    shared = texts.groupBy("learner_id").agg(F.countDistinct("split").alias("k")).agg(F.count_if(F.col("k") > 1).alias("n")).select(F.lit("learner in several splits").alias("problem"), "n")
    few = texts.groupBy("split", label).agg(F.count("*").alias("k")).agg(F.count_if(F.col("k") < 2).alias("n")).select(F.lit("label with under two texts").alias("problem"), "n")
    missing = texts.agg((3 - F.countDistinct("split")).alias("n")).select(F.lit("missing split").alias("problem"), "n")
    return shared.unionByName(few).unionByName(missing)


def grouped_folds(texts: DataFrame, k: int = 10, seed: int = 42) -> DataFrame:
    """(learner_id, fold): learners dealt to k folds so that each level's texts are as even as can be, one after the other
    from those of the most varied counts on, shuffled by a hash. A sequence over the learners' counts in one task; its
    state is k rows of counts."""
    counts = texts.groupBy("learner_id", "level").agg(F.count("*").alias("n"))
    levels = S.LEVELS

    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, where = np.unique(pdf["learner_id"], return_inverse=True)
        table = np.zeros((len(ids), levels + 1))
        np.add.at(table, (where, pdf["level"].to_numpy(int).clip(0, levels)), pdf["n"])
        share = table / np.maximum(table.sum(axis=0), 1)
        order = np.random.default_rng(seed).permutation(len(ids))
        order = order[np.argsort(-share[order].std(axis=1), kind="stable")]
        held, folds = np.zeros((k, levels + 1)), np.zeros(len(ids), dtype=int)
        size = np.zeros(k)
        for i in order:
            spread = ((held.sum(axis=0) + share[i]) / k - held) * share[i]
            f = min(range(k), key=lambda f: (-spread[f].sum(), size[f]))
            held[f] += share[i]
            size[f] += table[i].sum()
            folds[i] = f
        return pd.DataFrame({"learner_id": ids, "fold": folds})

    return counts.groupBy().applyInPandas(deal, "learner_id long, fold int")


def task_folds(texts: DataFrame, tasks: int = 8) -> DataFrame:
    """(level, topic, fold): the k-th task of each level, by topic, is in fold k."""
    fold = F.dense_rank().over(Window.partitionBy("level").orderBy("topic"))
    return texts.select("level", "topic").distinct().withColumn("fold", fold).where(F.col("fold") <= tasks)


def stratified_sample(texts: DataFrame, n: int, by: list[str], key: str = "text_id", seed: int = 42) -> DataFrame:
    """At most n rows of each group, those of the least md5 of seed and key. Groups may be large: their least hashes come
    from a partial top n in every task (a window whose limit Spark pushes below the exchange)."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    w = Window.partitionBy(*by).orderBy("_digest", key)
    return texts.withColumn("_digest", digest).withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).drop("_digest", "_k")


def hash_sample(texts: DataFrame, n: int, key: str) -> DataFrame:
    """n rows of the least md5 of the key."""
    return texts.withColumn("_digest", F.md5(F.col(key).cast("string"))).orderBy("_digest", key).limit(n).drop("_digest")


def bootstrap_weights(learners: DataFrame, draws: int = 2000, seed: int = 42) -> DataFrame:
    """(draw, learner_id, weight): how often each draw of ``bootstrap.Multinomial`` has a learner, in rows; weights of 0 are
    left out. For few learners, or to look at draws: ``bootstrap.run_draws`` makes no such rows."""
    blocks, sizes = bootstrap.blocks_of(learners)
    rule = bootstrap.Multinomial(sizes, draws, seed)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for block, members in zip(pdf["block"], pdf["members"], strict=True):
                for lo, w in rule.of(int(block), np.asarray(members)):
                    at, draw = np.nonzero(w)
                    yield pd.DataFrame({"draw": draw, "learner_id": np.asarray(members)[lo + at], "weight": w[at, draw]})

    return blocks.mapInPandas(run, "draw int, learner_id long, weight long")


def bootstrap_cells(rows: DataFrame, weights: DataFrame, actual: str, predicted: str) -> DataFrame:
    """(draw, actual, predicted, n): the weighted confusion of each draw. Texts are summed to learners' cells first."""
    cell = rows.groupBy("learner_id", F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("c"))
    return cell.join(weights, "learner_id").groupBy("draw", "actual", "predicted").agg(F.sum(F.col("c") * F.col("weight")).alias("n"))


def interval(draws: DataFrame, value: str, keys: list[str], low: float = 0.025, high: float = 0.975) -> DataFrame:
    """(keys, sd, low, high): deviation (null if over 5 % of draws are undefined) and percentile interval."""
    v = F.col(value)
    ok = F.count(v) >= 0.95 * F.count(F.lit(1))
    q = F.percentile(v, F.array(F.lit(low), F.lit(high)))
    return draws.groupBy(*keys).agg(F.when(ok, F.stddev_samp(v)).alias("sd"), q[0].alias("low"), q[1].alias("high"))


def paired_difference(draws: DataFrame, best: str) -> DataFrame:
    """(model, mean, low, high, distinguishable) of the best model's value less each other's, draw by draw."""
    top = draws.where(F.col("model") == best).select("draw", F.col("value").alias("top"))
    d = draws.where(F.col("model") != best).join(top, "draw").withColumn("d", F.col("top") - F.col("value"))
    q = F.percentile("d", F.array(F.lit(0.025), F.lit(0.975)))
    out = d.groupBy("model").agg(F.avg("d").alias("mean"), q[0].alias("low"), q[1].alias("high"))
    return out.withColumn("distinguishable", (F.col("low") > 0) | (F.col("high") < 0))


def weighted_pearson(rows: DataFrame, x: str, y: str, w: str, by: list[str]) -> DataFrame:
    a, b, c = (F.col(k).cast("double") for k in (x, y, w))
    n, sx, sy = F.sum(c), F.sum(c * a), F.sum(c * b)
    vx, vy = F.sum(c * a * a) - sx * sx / n, F.sum(c * b * b) - sy * sy / n
    both: Column = F.sqrt(F.greatest(vx, F.lit(0.0)) * F.greatest(vy, F.lit(0.0)))
    return rows.groupBy(*by).agg(F.when(both > 0, (F.sum(c * a * b) - sx * sy / n) / F.when(both > 0, both)).alias("r"))
