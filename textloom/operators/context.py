"""What stands beside stored scores: length flags, ranks without flagged features, settings, progressions, error trends."""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.sources import files

#: Settings of a progression and their defaults.
SETTINGS = {"common_usage_percent": 70.0, "comparison_thresholds": [2.0, 10.0], "min_texts_per_level": 100, "min_feature_coverage_percent": 95.0, "min_later_levels": 2}


def relabel(scores: DataFrame, listed: DataFrame, score: str = "score") -> DataFrame:
    """Stored scores with flags and ranks anew, without scoring: is_length by the (source, feature) pairs of ``listed``
    in any case, rank over all and rank_without_length over those that are not flagged (null for the others)."""
    flag = listed.select(F.lower("source").alias("_s"), F.lower("feature").alias("_f")).distinct()
    rows = scores.drop("is_length", "rank", "rank_without_length").join(F.broadcast(flag), (F.lower("source") == F.col("_s")) & (F.lower("feature") == F.col("_f")), "left")
    rows = rows.withColumn("is_length", F.col("_f").isNotNull()).drop("_s", "_f")
    best = [F.col(score).desc_nulls_last(), "source", "feature"]  # one row for each feature
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*best)))
    return rows.withColumn("rank_without_length", F.when(~F.col("is_length"), F.row_number().over(Window.partitionBy("is_length").orderBy(*best))))


def check_settings(settings: dict) -> dict:
    """settings over the defaults; raises where one is out of its range."""
    out = {**SETTINGS, **settings}
    for x in (out["common_usage_percent"], *out["comparison_thresholds"]):
        if not (math.isfinite(x) and 0 < x <= 100):
            raise ValueError("a common-usage threshold lies in (0, 100]")
    coverage = out["min_feature_coverage_percent"]
    if not (math.isfinite(coverage) and 0 < coverage <= 100):
        raise ValueError("min_feature_coverage_percent lies in (0, 100]")
    for name, most in (("min_texts_per_level", math.inf), ("min_later_levels", 14)):
        if int(out[name]) != out[name] or not 1 <= out[name] <= most:
            raise ValueError(f"{name} is a whole number from 1 to {most}")
    return out


def put_settings(settings: dict, path: str) -> None:
    """Keeps settings as JSON, for the file beside a summary."""
    files.put(path, json.dumps(check_settings(settings), indent=1).encode())


def settings_of(path: str) -> dict:
    """The settings kept at path, checked; defaults for those that it lacks. Unknown names raise."""
    kept = json.loads(files.get(path))
    if unknown := sorted(kept.keys() - SETTINGS.keys()):
        raise ValueError(f"unknown settings: {unknown}")
    return check_settings(kept)


def annotated(scores: DataFrame, descriptions: DataFrame, progressions: DataFrame) -> DataFrame:
    """scores with description, first_common, sustained_from and status of the features that have them, '' and null else.
    descriptions: (feature, description); progressions: one row for each feature."""
    p = progressions.select("feature", "first_common", "sustained_from", "status")
    out = scores.join(F.broadcast(descriptions.dropDuplicates(["feature"])), "feature", "left").join(F.broadcast(p.dropDuplicates(["feature"])), "feature", "left")
    return out.fillna("", ["description", "status"])


def error_trends(rows: DataFrame | None) -> tuple[DataFrame | None, str]:
    """(level, texts, rate) of the course levels of an error summary, and why there is none. The context is optional: a
    missing table, column or level, a repeated level or a negative value skips it, and says so."""
    if rows is None:
        return None, "no error summary"
    need = {"group_type", "level", "texts", "pooled_rate"}
    if not need <= {c.strip().casefold() for c in rows.columns}:
        return None, f"columns missing: {sorted(need - {c.strip().casefold() for c in rows.columns})}"
    rows = rows.toDF(*[c.strip().casefold() for c in rows.columns])
    own = rows.where(F.lower(F.trim("group_type")) == "level").select(F.expr("try_cast(level as int)").alias("level"), F.expr("try_cast(texts as bigint)").alias("texts"), F.expr("try_cast(pooled_rate as double)").alias("rate"))
    ok = F.coalesce(F.col("level").between(1, 15) & (F.col("texts") >= 0) & (F.col("rate") >= 0), F.lit(False))
    n, good, levels = own.agg(F.count("*"), F.count_if(ok), F.countDistinct("level")).first()
    if not n:
        return None, "no course levels"
    if good < n or levels < n:
        return None, "invalid or repeated course levels"
    return own.orderBy("level"), ""
