"""Experiments: jobs with dependencies and costs, models of many jobs side by side, transfer to unseen tasks, seals."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.functions import scalars as S
from textloom.operators import additive, metrics, resample
from textloom.sources import files, writers

JOBS = "job_id string, kind string, task string, algorithm string, family string, fold int, depends_on string, cost double"

#: The cost of a fit beside that of a regressor, and of a baseline.
COSTS = {"classifier": 9.0, "regressor": 1.0, "majority": 0.0, "median": 0.0}
#: Which baseline stands beside which kind of model.
BASELINES = {"classifier": "majority", "regressor": "median"}


def job_table(tasks: list[str], algorithms: list[str], families: list[str], folds: int) -> list[tuple]:
    """All jobs: a ranking for each fold, which the fits of families named top_* wait for, fits, and baselines."""
    jobs = [(f"ranking__{k}", "ranking", "", "", "", k, None, 0.5) for k in range(folds)]
    for task in tasks:
        for algorithm in algorithms:
            jobs += [(f"{task}__{algorithm}__{family}__{k}", "fit", task, algorithm, family, k, f"ranking__{k}" if family.startswith("top_") else None, COSTS[algorithm]) for family in families for k in range(folds)]
            base = BASELINES[algorithm]
            jobs += [(f"{task}__{base}__{k}", "baseline", task, base, "", k, None, COSTS[base]) for k in range(folds)]
    return jobs


def jobs(spark: SparkSession, tasks: list[str], algorithms: list[str], families: list[str], folds: int) -> DataFrame:
    return spark.createDataFrame(job_table(tasks, algorithms, families, folds), JOBS)


def job_order(table: DataFrame, first: list[str] = ()) -> DataFrame:
    """table with place: rankings, then the families asked for first, then the dearest, then by id."""
    asked = F.col("family").isin(list(first)) if first else F.lit(False)
    order = Window.partitionBy(F.lit(0)).orderBy((F.col("kind") != "ranking").cast("int"), (~asked).cast("int"), F.col("cost").desc(), "job_id")
    return table.withColumn("place", F.row_number().over(order))


def fit_all(rows: DataFrame, models: dict[str, list[str]], label: str, kind: str, rounds: int = additive.ROUNDS, bins: int = additive.BINS) -> DataFrame:
    """Terms of a model for each set of features and of its baseline. All models have the same rows, of which few are copied
    to a task for each model and many are counted once for all models; a lost task is run again by Spark."""
    every = list(dict.fromkeys(f for v in models.values() for f in v))
    terms = additive.fit(rows, every, label, kind, rounds, bins, models)
    return terms.unionByName(additive.dummy(rows, label, kind))


def transfer(rows: DataFrame, features: list[str], rounds: int = additive.ROUNDS, bins: int = additive.BINS) -> DataFrame:
    """(direction, part, n, mae, rmse, r2): regressors trained without one half of the tasks, in both directions, scored
    on validation texts of tasks they have and have not seen."""
    folds = resample.task_folds(rows).select("level", "topic", (F.col("fold") <= 4).alias("low"))
    split = resample.with_split(rows).join(F.broadcast(folds), ["level", "topic"])
    train = split.where("split = 'train'").withColumn("model", F.when(F.col("low"), "low").otherwise("high"))
    terms = additive.fit(train, features, "level", "regressor", rounds, bins)
    test = split.where("split = 'validation'")
    scored = additive.predict(test, features, terms).select("text_id", F.col("model").alias("direction"), S.clamp(F.col("score"), 1.0, float(S.LEVELS)).alias("p"))
    part = F.when((F.col("direction") == "low") == F.col("low"), "seen").otherwise("unseen")
    return metrics.regression_scores(test.join(scored, "text_id").withColumn("part", part), "level", "p", ["direction", "part"])


def seal(runs: dict[str, DataFrame], path: str) -> None:
    """Freezes the digests of all runs before any test label is read; a seal is never written twice."""
    if files.exists(path):
        raise FileExistsError(path)
    writers.write_manifest(runs, path)


def check_seal(runs: dict[str, DataFrame], path: str) -> None:
    changed = writers.verify_manifest(runs, path)
    if changed:
        raise ValueError(f"changed since the seal: {changed}")


def complete(path: str, config: dict) -> bool:
    """Whether a run of this configuration is recorded as finished."""
    return files.exists(path) and json.loads(files.get(path)).get("config") == json.loads(json.dumps(config))


def recorded(path: str) -> dict:
    """What is recorded of a run, {} if nothing is."""
    return json.loads(files.get(path)) if files.exists(path) else {}


def record(path: str, config: dict, minutes: float) -> None:
    writers.write_json({"config": config, "minutes": minutes}, path)
