"""Joins and checks that fail on the driver instead of dropping rows in silence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.functions import scalars as S


def unique(df: DataFrame, key: str) -> DataFrame:
    """df, after a check that its key is never null and never repeated."""
    bad = df.groupBy(key).agg(F.count("*").alias("n")).where(F.col(key).isNull() | (F.col("n") > 1)).limit(1).count()
    if bad:
        raise ValueError(f"{key} is null or repeated")
    return df


def wide(sources: list[DataFrame], key: str = "text_id") -> DataFrame:
    """The inner join of all sources on the key: sort-merge joins that keep one partitioning by the key."""
    names = [c.lower() for s in sources for c in s.columns if c != key]
    if len(set(names)) < len(names):
        raise ValueError("a column has the same name in two sources")
    return reduce(lambda a, b: a.join(b, key), sources)


def long_form(rows: DataFrame, features: list[str], keys: list[str]) -> DataFrame:
    """(keys, feature, value), nulls kept. Values go through one array with their places, and names come from a broadcast row
    for each feature: the plan stays the same size for any number of features, where an unpivot has a projection for each."""
    names = rows.sparkSession.createDataFrame(list(enumerate(features)), "_place int, feature string")
    values = f"array({', '.join(f'cast({S.quoted(f)} as double)' for f in features)})"  # one text: a call for each column costs more than the plan
    return rows.select(*keys, F.posexplode(F.expr(values)).alias("_place", "value")).join(F.broadcast(names), "_place").select(*keys, "feature", "value")


def agreement(a: DataFrame, b: DataFrame, key: str, labels: list[str]) -> DataFrame:
    """(only_left, only_right, different, equal) of a full outer join of two tables by key, labels null-safe."""
    left, right = a.select(F.col(key).alias("_k"), F.struct(*labels).alias("x")), b.select(F.col(key).alias("_j"), F.struct(*labels).alias("y"))
    j = left.join(right, F.col("_k") == F.col("_j"), "full_outer")
    both = F.col("_k").isNotNull() & F.col("_j").isNotNull()
    return j.agg(F.count_if(F.col("_j").isNull()).alias("only_left"), F.count_if(F.col("_k").isNull()).alias("only_right"), F.count_if(both & ~F.col("x").eqNullSafe(F.col("y"))).alias("different"), F.count_if(both & F.col("x").eqNullSafe(F.col("y"))).alias("equal"))


def pairing(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, state): both, left only, right only."""
    j = a.select(F.col(key).alias("_a")).join(b.select(F.col(key).alias("_b")), F.col("_a") == F.col("_b"), "full_outer")
    state = F.when(F.col("_b").isNull(), "left only").when(F.col("_a").isNull(), "right only").otherwise("both")
    return j.select(F.coalesce("_a", "_b").alias(key), state.alias("state"))


def pending(work: DataFrame, done: DataFrame, failed: DataFrame, key: str, tries: int = 3) -> DataFrame:
    """work without what is done or has failed ``tries`` times or more."""
    spent = failed.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") >= tries)
    return work.join(done.select(key), key, "left_anti").join(spent.select(key), key, "left_anti")


def latest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key: an append-only table read as if it were updated in place."""
    w = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order])
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def pivot_counts(edits: DataFrame, texts: DataFrame, types: list[str]) -> DataFrame:
    """One row for each text with a column for each type's number of edits, 0 where it has none."""
    own = edits.groupBy("text_id").pivot("error_type", types).agg(F.count(F.lit(1)))
    return texts.select("text_id").join(own, "text_id", "left").fillna(0, types)


def context(features: DataFrame, exact: DataFrame, general: DataFrame, default: str) -> DataFrame:
    """features with label: by feature from ``exact``, else by source from ``general``, else the default."""
    return features.join(F.broadcast(exact), "feature", "left").join(F.broadcast(general), "source", "left").select("feature", "source", F.coalesce("exact_label", "general_label", F.lit(default)).alias("label"))


def merge_parts(done: DataFrame, parts: list[DataFrame], key: str, needed: list[str]) -> DataFrame:
    """done and, of the keys that it lacks, the rows of the parts that came in since: those whose ``needed`` columns are all
    there (others of a broken part are salvaged), of several the one of the latest part."""
    every = reduce(DataFrame.unionByName, [p.withColumn("_part", F.lit(i)) for i, p in enumerate(parts)])
    whole = every.dropna(subset=[key, *needed])
    new = whole.join(done.select(key), key, "left_anti")
    return done.unionByName(latest(new, key, ["_part"]).drop("_part").select(*done.columns))


#: The experiments of features by name: what a feature's flags must be. The names and what they include.
FEATURE_SETS = {
    "complexity": "kind = 'complexity'", "accuracy": "kind = 'accuracy'", "combined": "kind in ('complexity', 'accuracy')", "combined_plus_error_composition": "kind in ('complexity', 'accuracy', 'composition')",
    "complexity_without_length_features": "kind = 'complexity' and not direct", "combined_without_length_features": "kind in ('complexity', 'accuracy') and not direct",
    "complexity_without_length_correlated_features": "kind = 'complexity' and not direct and not correlated", "combined_without_length_correlated_features": "kind in ('complexity', 'accuracy') and not direct and not correlated",
    "combined_without_duplicate_features": "kind in ('complexity', 'accuracy') and not duplicate", "combined_without_length_and_duplicate_features": "kind in ('complexity', 'accuracy') and not direct and not duplicate",
    "combined_without_length_correlated_and_duplicate_features": "kind in ('complexity', 'accuracy') and not direct and not correlated and not duplicate", "one_source": "kind = 'complexity' and one_source",
    "training_mutual_information_features": "mi", "training_information_gain_features": "ig", "length_only": "direct",
}


def feature_sets(features: DataFrame, rules: dict[str, str] = FEATURE_SETS) -> DataFrame:
    """(name, feature) of every experiment, from a row for each feature with its flags: kind, direct, correlated, duplicate
    (the lists of length-dependent and of duplicate features), one_source, mi and ig (chosen by a ranking of training rows)."""
    names = F.filter(F.array(*[F.when(F.expr(rule), F.lit(name)) for name, rule in rules.items()]), lambda x: x.isNotNull())
    return features.select(F.explode(names).alias("name"), "feature")
