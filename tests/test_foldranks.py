"""Rankings inside folds from complement counts equal a ranking of each fold's training texts."""

import math

import numpy as np
from pyspark.sql import functions as F

from textloom.operators import foldranks, information


def test_rankings_equal_those_of_each_folds_training_texts(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(900):
        y, fold = int(rng.integers(1, 6)), int(rng.integers(0, 4))
        values = {"signal": y + rng.normal(), "many": float(rng.integers(0, 6)), "noise": rng.normal() * 1e6, "flat": 2.0, "own": float(fold == 2), "few": y * 1.0 if i < 40 and fold != 1 else None, "zero": -abs(rng.normal()) if i % 2 else 0.0}
        for name, v in values.items():
            rows.append((name, None if v is None or rng.random() < 0.1 else float(v), y, fold))
    long = spark.createDataFrame(rows, "feature string, value double, level int, fold int").cache()
    got = {(r["fold"], r["feature"]): r for r in foldranks.rankings(long, "level", 4, 2).collect()}
    cuts = {(r["fold"], r["feature"]): r["threshold"] for r in foldranks.gains(long, "level", 4).collect()}
    for fold in range(4):
        train = long.where(F.col("fold") != fold)
        for r in information.binned_information(train).collect():
            assert math.isclose(got[fold, r["feature"]]["mi"], r["mi"], abs_tol=1e-9), (fold, r["feature"])
        for r in information.information_gain(train).collect():
            assert math.isclose(got[fold, r["feature"]]["ig"], r["gain"], abs_tol=1e-9), (fold, r["feature"])
            assert cuts[fold, r["feature"]] == r["threshold"] or math.isclose(cuts[fold, r["feature"]], r["threshold"])
        best = sorted((f for k, f in got if k == fold), key=lambda f: (-got[fold, f]["ig"], f))
        assert [got[fold, f]["ig_rank"] for f in best] == list(range(1, len(best) + 1)) and [f for f in best if got[fold, f]["ig_selected"]] == best[:2]
    assert len(got) == 4 * 7
    long.unpersist()


def test_no_texts_no_rankings(spark):
    assert foldranks.rankings(spark.createDataFrame([], "feature string, value double, level int, fold int"), "level", 3).count() == 0
