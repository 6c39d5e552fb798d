"""Descriptive statistics of features, error profiles and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.functions import scalars as S

#: Edits of a task that counts those of each text.
TASK_EDITS = 500_000


def feature_statistics(long: DataFrame, *by: str) -> DataFrame:
    """Count, mean, sample deviation, least and largest value of each feature (within ``by``); all-null features go."""
    out = long.groupBy("feature", *by).agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.min("value").alias("low"), F.max("value").alias("high")
    )
    return out.where("n > 0")


def usable_features(long: DataFrame, least: int = 20) -> DataFrame:
    """Features of at least ``least`` values that vary."""
    return feature_statistics(long).where((F.col("n") >= least) & (F.col("low") != F.col("high"))).select("feature", "n")


def error_statistics(frame: DataFrame, errors: str, words: str, equal: str) -> DataFrame:
    """Texts, pooled and mean error rates, share of error-free texts and token-weighted accuracy for all texts, each band
    and each (band, level): one pass over the texts by grouping sets."""
    rate = S.per_hundred(F.col(errors), F.col(words))
    rows = frame.withColumn("_rate", rate)
    out = rows.groupingSets([[], ["cefr_level"], ["cefr_level", "level"]], "cefr_level", "level").agg(
        F.grouping_id().alias("g"), F.count("*").alias("texts"), F.sum(errors).alias("errors"), F.sum(words).alias("words"), F.avg("_rate").alias("mean_rate"),
        F.count_if(F.col(errors) == 0).alias("error_free"), F.sum(equal).alias("_equal"),
    )
    kind = F.when(F.col("g") == 3, "overall").when(F.col("g") == 1, "cefr").otherwise("cefr_level")
    accuracy = F.greatest(F.lit(0.0), 1 - F.when(F.col("words") != 0, F.col("_equal") / F.col("words")).otherwise(F.lit(0.0)))
    return out.select(kind.alias("group_type"), "cefr_level", "level", "texts", "errors", S.per_hundred(F.col("errors"), F.col("words")).alias("pooled_rate"), "mean_rate", (100.0 * F.col("error_free") / F.col("texts")).alias("error_free_percent"), accuracy.alias("accuracy"))


def _edits_and_texts(edits: DataFrame, texts: DataFrame, keys: list[str], labels: list[str], name: str) -> DataFrame:
    """(labels, keys, n, name): edits, and distinct texts with one, of each combination. A text's edits are counted by keys
    before they meet its labels, so a distinct text is a row there and is exchanged once; tasks have about TASK_EDITS edits,
    however many there are. A text_id of several rows counts its edits with each, and once among the texts of equal labels."""
    parts = max(int(edits.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-edits.count() // TASK_EDITS))
    own = edits.select("text_id", *keys).repartition(parts, "text_id").groupBy("text_id", *keys).agg(F.count("*").alias("_n"))
    rows = texts.select("text_id", *labels).repartition(parts, "text_id").groupBy("text_id", *labels).agg(F.count("*").alias("_rows"))
    return own.join(rows, "text_id").groupBy(*labels, *keys).agg(F.sum(F.col("_n") * F.col("_rows")).alias("n"), F.count("*").alias(name))


def error_types(edits: DataFrame, texts: DataFrame) -> DataFrame:
    """For each band and error type: edits, texts with it, their share of the band's texts and of its edits, and two
    row ranks, by number and by share of texts."""
    out = _edits_and_texts(edits, texts, ["error_type"], ["cefr_level"], "texts_with").withColumnRenamed("n", "edits")
    total = texts.groupBy("cefr_level").agg(F.count("*").alias("texts"))
    out = out.join(total, "cefr_level").withColumn("text_percent", 100.0 * F.col("texts_with") / F.col("texts"))
    group = Window.partitionBy("cefr_level")
    out = out.withColumn("edit_share", F.col("edits") / F.sum("edits").over(group).cast("double"))
    out = out.withColumn("count_rank", F.row_number().over(group.orderBy(F.col("edits").desc(), "error_type")))
    return out.withColumn("percent_rank", F.row_number().over(group.orderBy(F.col("text_percent").desc(), "error_type")))


def patterns(edits: DataFrame, texts: DataFrame, keys: list[str], labels: list[str], within: list[str]) -> DataFrame:
    """Edits and distinct texts of each combination of the texts' ``labels`` and the edits' ``keys``, and its share of the edits
    of ``within``."""
    out = _edits_and_texts(edits, texts, keys, labels, "texts")
    return out.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*within)).cast("double"))


def text_rollup(edits: DataFrame) -> DataFrame:
    """Per text: edits by operation, distinct types, changed tokens and tokens covered by the union of its spans."""
    op = S.operation(F.col("error_type"))
    count = [F.count_if(op == x).alias(x) for x in ("missing", "unnecessary", "replacement", "other")]
    return edits.groupBy("text_id").agg(
        F.count("*").alias("edits"), *count, F.countDistinct("error_type").alias("types"), F.sum(F.greatest(F.col("stop") - F.col("start"), F.lit(1))).alias("changed"),
        S.covered(F.collect_list(F.struct("start", "stop"))).alias("covered"),
    )


def covered_by_windows(edits: DataFrame) -> DataFrame:
    """(text_id, covered) by gaps and islands: a span adds what lies beyond the furthest end before it."""
    w = Window.partitionBy("text_id").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    spans = edits.where("stop > start").withColumn("_end", F.max("stop").over(w))
    new = F.greatest(F.lit(0), F.col("stop") - F.greatest("start", F.coalesce("_end", "start")))
    return spans.groupBy("text_id").agg(F.sum(new).alias("covered"))


def counts_with_subtotals(texts: DataFrame) -> DataFrame:
    """Texts of each (band, level), each band and all, in one rollup."""
    out = texts.rollup("cefr_level", "level").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    return out.select("cefr_level", "level", "n", F.col("g").cast("long").alias("subtotal"))


def histogram(df: DataFrame, label: Column, name: str = "label") -> DataFrame:
    return df.groupBy(label.alias(name)).agg(F.count("*").alias("n"))


def usage(long: DataFrame, words: DataFrame, levels: int = S.LEVELS) -> DataFrame:
    """Use of each feature at each level, on a dense spine of levels: texts, valid values, texts with a positive value,
    prevalence in percent, the pooled rate per word and whether that is evidence enough.

    words: (text_id, words). A value is valid if it and the words are positive or 0 and finite; other rows only count.
    """
    rows = long.join(words, "text_id", "left")
    ok = S.finite(F.col("value")).isNotNull() & (F.col("value") >= 0) & (F.col("words") > 0)
    cell = rows.groupBy("feature", "level").agg(
        F.count("*").alias("texts"), F.count_if(ok).alias("valid"), F.count_if(ok & (F.col("value") > 0)).alias("using"),
        F.sum(F.when(ok, F.col("value"))).alias("_sum"), F.sum(F.when(ok, F.col("words"))).alias("_words"),
    )
    spine = long.select("feature").distinct().withColumn("level", F.explode(F.sequence(F.lit(1), F.lit(levels))))
    out = spine.join(cell, ["feature", "level"], "left").fillna(0, ["texts", "valid", "using"])
    return out.select("feature", "level", "texts", "valid", "using", (100.0 * S.ratio(F.col("using"), F.col("valid"))).alias("prevalence"), S.ratio(F.col("_sum"), F.col("_words")).alias("pooled_rate"), S.evidence(F.col("texts"), F.col("valid")).alias("evidence"))


def progression(use: DataFrame, threshold: float, later: int = 2) -> DataFrame:
    """From dense usage: each feature's first level of any use, first common level (prevalence at or over threshold),
    the level from which all later ones are common (at least ``later`` of them), later drops, levels without evidence."""
    cells = use.groupBy("feature").agg(F.array_sort(F.collect_list(F.struct("level", "prevalence", "evidence"))).alias("c"))
    common = lambda x: F.coalesce(x["prevalence"] >= threshold, F.lit(False))
    first = lambda test: F.array_min(F.transform(F.filter("c", test), lambda x: x["level"]))
    tail = lambda x: F.filter("c", lambda y: y["level"] > x["level"])
    sustained = lambda x: common(x) & (F.size(tail(x)) >= later) & F.forall(tail(x), common)
    out = cells.select("feature", first(lambda x: x["prevalence"] > 0).alias("first_observed"), first(common).alias("first_common"), first(sustained).alias("sustained_from"), F.size(F.filter("c", lambda x: x["evidence"] != "sufficient")).alias("insufficient"), "c")
    drops = F.size(F.filter("c", lambda x: (x["level"] > F.col("first_common")) & ~common(x)))
    status = F.when(F.col("first_observed").isNull(), "never observed").when(F.col("sustained_from").isNotNull(), "sustained").when(F.col("first_common").isNotNull(), "common, not sustained").otherwise("observed, not common")
    return out.select("feature", "first_observed", "first_common", "sustained_from", F.coalesce(drops, F.lit(0)).alias("drops"), "insufficient", status.alias("status"))


def tally(rows: DataFrame, level: Column, words: Column) -> DataFrame:
    """Rows by the reason for which a text is left out, '' for none; a bad level goes before bad words."""
    reason = F.when(level.isNull(), "bad level").when(words.isNull(), "bad word count").when(words <= 0, "no words").otherwise("")
    return histogram(rows, reason, "reason")
