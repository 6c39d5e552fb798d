"""Scores of ordinal classifiers and regressors, their summaries over folds, and contribution tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from textloom.functions import scalars as S


def confusion(rows: DataFrame, actual: str, predicted: str, labels: list, by: list[str] | None = None) -> DataFrame:
    """(by, actual, predicted, n) for all pairs of the labels, 0 where none is, positions i and j of the labels too."""
    by = by or []
    n = rows.groupBy(*by, F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))
    spot = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(x).alias("x")) for i, x in enumerate(labels)]))
    groups = n.select(*by).distinct() if by else rows.sparkSession.range(1).select()
    spine = groups.withColumn("a", spot).withColumn("p", spot)
    spine = spine.select(*by, F.col("a.x").alias("actual"), F.col("p.x").alias("predicted"), F.col("a.i").alias("i"), F.col("p.i").alias("j"))
    return spine.join(n, [*by, "actual", "predicted"], "left").fillna(0, ["n"])


def _div(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b != 0, a.cast("double") / b.cast("double")).otherwise(F.lit(0.0))


def class_scores(matrix: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, label, support, precision, recall, f1, accuracy) of each label of a confusion matrix. Precision, recall and
    F1 are 0 where undefined; accuracy within the label is null without support."""
    by = by or []
    hit = F.when(F.col("i") == F.col("j"), F.col("n")).otherwise(0)
    rows = matrix.select(*by, F.col("actual").alias("label"), "n", hit.alias("hit"), F.lit(0).alias("guess"))
    cols = matrix.select(*by, F.col("predicted").alias("label"), F.lit(0).alias("n"), F.lit(0).alias("hit"), F.col("n").alias("guess"))
    out = rows.unionByName(cols).groupBy(*by, "label").agg(F.sum("n").alias("support"), F.sum("hit").alias("hit"), F.sum("guess").alias("guess"))
    return out.select(*by, "label", "support", _div(F.col("hit"), F.col("guess")).alias("precision"), _div(F.col("hit"), F.col("support")).alias("recall"), _div(2 * F.col("hit"), F.col("support") + F.col("guess")).alias("f1"), S.ratio(F.col("hit"), F.col("support")).alias("accuracy"))


def overall_scores(matrix: DataFrame, labels: int, by: list[str] | None = None) -> DataFrame:
    """(by, n, accuracy, macro_f1, ordinal_mae, within_one, qwk): macro F1 over all labels, with or without support;
    quadratic weighted kappa null where undefined."""
    by = by or []
    f1 = class_scores(matrix, by).groupBy(*by).agg((F.sum("f1") / labels).alias("macro_f1"))
    gap = F.abs(F.col("i") - F.col("j")).cast("double")
    n = F.sum("n").over(Window.partitionBy(*(by or [F.lit(0)]))).cast("double")
    row = F.sum("n").over(Window.partitionBy(*by, "i")).cast("double")
    col = F.sum("n").over(Window.partitionBy(*by, "j")).cast("double")
    cell = matrix.withColumn("gap", gap).withColumn("expected", F.when(n > 0, row * col / n))
    w = F.col("gap") * F.col("gap")
    total = F.sum("n")
    out = cell.groupBy(*by).agg(
        total.alias("n"), S.ratio(F.sum(F.when(F.col("gap") == 0, F.col("n")).otherwise(0)), total).alias("accuracy"), S.ratio(F.sum(F.col("gap") * F.col("n")), total).alias("ordinal_mae"),
        S.ratio(F.sum(F.when(F.col("gap") <= 1, F.col("n")).otherwise(0)), total).alias("within_one"), (1 - S.ratio(F.sum(w * F.col("n")), F.sum(w * F.col("expected")))).alias("qwk"),
    )
    return out.join(f1, by) if by else out.join(f1)


def regression_scores(rows: DataFrame, actual: str, predicted: str, by: list[str] | None = None) -> DataFrame:
    """(by, n, mae, rmse, r2) of continuous predictions."""
    d = F.col(predicted).cast("double") - F.col(actual).cast("double")
    sst = F.var_pop(F.col(actual).cast("double")) * F.count(actual)
    return rows.groupBy(*(by or [])).agg(F.count("*").alias("n"), F.avg(F.abs(d)).alias("mae"), F.sqrt(F.avg(d * d)).alias("rmse"), F.when(sst > 0, 1 - F.sum(d * d) / F.when(sst > 0, sst)).alias("r2"))


def confusion_percent(matrix: DataFrame, by: list[str] | None = None) -> DataFrame:
    """matrix with percent of the actual class, 0 for a class without rows."""
    total = F.sum("n").over(Window.partitionBy(*(by or []), "actual"))
    return matrix.withColumn("percent", _div(100.0 * F.col("n"), total))


def band_probabilities(rows: DataFrame, probabilities: list[str], size: int, bands: list[str]) -> DataFrame:
    """rows with probability_<band>, the sums of each ``size`` levels' probabilities, the likeliest band (the first of
    equals) and the expected level."""
    sums = [sum((F.col(c) for c in probabilities[i + 1 : i + size]), F.col(probabilities[i])) for i in range(0, len(probabilities), size)]
    array = F.array(*sums)
    best = F.element_at(F.array(*map(F.lit, bands)), F.array_position(array, F.array_max(array)).cast("int"))
    expected = sum(((k + 1) * F.col(c) for k, c in enumerate(probabilities[1:], 1)), F.col(probabilities[0]))
    return rows.select("*", *[s.alias(f"probability_{b}") for s, b in zip(sums, bands, strict=True)], best.alias("band"), expected.alias("expected_level"))


def baselines(rows: DataFrame, label: str, number: str) -> DataFrame:
    """(majority, median): the most frequent label, the smallest of equals, and the exact median."""
    counts = rows.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    top = counts.agg(F.min(F.struct((-F.col("n")).alias("n"), "label")).alias("x")).select(F.col("x.label").alias("majority"))
    return top.join(rows.agg(F.median(number).alias("median")))


def fold_summary(scores: DataFrame, keys: list[str], folds: int) -> DataFrame:
    """(keys, metric, mean, sd) over folds, only for models of which all folds are there."""
    out = scores.groupBy(*keys, "metric").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.countDistinct("fold").alias("_k"))
    return out.where(F.col("_k") == folds).drop("_k")


def contributions(scores: DataFrame, group: str | None = None) -> DataFrame:
    """(feature or group, output, mean_absolute): per text a group's terms add up first, then the size counts."""
    name = group or "feature"
    per_text = scores.groupBy("text_id", name, "output").agg(F.sum("score").alias("s"))
    return per_text.groupBy(name, "output").agg(F.avg(F.abs("s")).alias("mean_absolute"))


def contribution_shares(table: DataFrame, name: str) -> DataFrame:
    """Shares within each output and, as output 'overall', of the mean over the outputs, with a row rank."""
    overall = table.groupBy(name).agg(F.avg("mean_absolute").alias("mean_absolute")).withColumn("output", F.lit("overall"))
    both = table.unionByName(overall)
    w = Window.partitionBy("output")
    return both.select(name, "output", "mean_absolute", S.ratio(F.col("mean_absolute"), F.sum("mean_absolute").over(w)).alias("share"), F.row_number().over(w.orderBy(F.col("mean_absolute").desc(), name)).alias("rank"))


def stability(importance: DataFrame, folds: int, top: int = 20) -> DataFrame:
    """(feature, mean, sd, folds_present, mean_rank, folds_in_top): an absent fold's importance is 0, its rank none."""
    rank = F.row_number().over(Window.partitionBy("fold").orderBy(F.col("importance").desc(), "feature"))
    r = importance.withColumn("rank", rank)
    x = F.col("importance")
    out = r.groupBy("feature").agg(F.sum(x).alias("s"), F.sum(x * x).alias("ss"), F.count("*").alias("folds_present"), F.avg("rank").alias("mean_rank"), F.count_if(F.col("rank") <= top).alias("folds_in_top"))
    mean = F.col("s") / folds
    return out.select("feature", mean.alias("mean"), F.sqrt(F.greatest(F.lit(0.0), (F.col("ss") - folds * mean * mean) / (folds - 1))).alias("sd"), "folds_present", "mean_rank", "folds_in_top")


def leaderboard(scores: DataFrame) -> DataFrame:
    """scores with rank within (target, split): macro F1, then accuracy, then the smaller ordinal error, then the name."""
    order = Window.partitionBy("target", "split").orderBy(F.col("macro_f1").desc(), F.col("accuracy").desc(), "ordinal_mae", "model")
    return scores.withColumn("rank", F.row_number().over(order))


def corrected_t(differences: DataFrame, n_train: int, n_test: int) -> DataFrame:
    """(k, mean, t, df) of fold differences by the corrected resampled t; t null where all differences are equal and not
    0, 0 where they all are 0."""
    k, mean, var = F.count("d"), F.avg("d"), F.var_samp("d")
    scale = (F.lit(1.0) / k + float(n_test) / n_train) * var
    return differences.agg(k.alias("k"), mean.alias("mean"), F.when(scale > 0, mean / F.sqrt(F.when(scale > 0, scale))).when(mean == 0, F.lit(0.0)).alias("t"), (k - 1).alias("df"))


def t_tail(t: float, df: int) -> float:
    """The two-sided p of Student's t, by the continued fraction of the regularised incomplete beta function."""
    import math

    x, a, b = df / (df + t * t), df / 2, 0.5
    if x >= 1:
        return 1.0

    def fraction(a: float, b: float, x: float) -> float:
        tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
        d = 1 / (d if abs(d) > tiny else tiny)
        h = d
        for m in range(1, 300):
            for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 + num * d
                d = 1 / (d if abs(d) > tiny else tiny)
                c = 1 + num / c
                c = c if abs(c) > tiny else tiny
                h *= d * c
            if abs(d * c - 1) < 1e-15:
                break
        return h

    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(b, a, 1 - x) / b


@F.pandas_udf(T.DoubleType())
def t_p(t: pd.Series, df: pd.Series) -> pd.Series:
    """The two-sided p of t, null for a null t; one value for each comparison."""
    return pd.Series([None if pd.isna(x) else t_tail(float(x), int(k)) for x, k in zip(t, df, strict=True)], dtype="float64")


def transfer_gap(scores: DataFrame) -> DataFrame:
    """(model, gap, extra): seen minus unseen, averaged over both directions, and that less the main model's gap."""
    per = scores.groupBy("model", "direction").agg(F.max(F.when(F.col("part") == "seen", F.col("value"))).alias("s"), F.max(F.when(F.col("part") == "unseen", F.col("value"))).alias("u"))
    gap = per.groupBy("model").agg(F.avg(F.col("s") - F.col("u")).alias("gap"))
    main = F.max(F.when(F.col("model") == "main", F.col("gap"))).over(Window.partitionBy(F.lit(0)))  # a row for each model
    return gap.select("model", "gap", (F.col("gap") - main).alias("extra"))


def fifths(rows: DataFrame, group: str, order: str, tie: str) -> DataFrame:
    """rows with fifth: equal cuts of the first-come ranks within the group, as quantiles of the ranks give them."""
    w = Window.partitionBy(group)
    n, rn = F.count("*").over(w), F.row_number().over(w.orderBy(order, tie))
    return rows.withColumn("fifth", F.when(n > 1, F.greatest(F.lit(1), F.ceil((rn - 1) * 5 / F.when(n > 1, n - 1).cast("double")))).otherwise(1).cast("int"))
