"""Properties, hand-computed values and expected failures of the operators."""

import difflib
import inspect
import json
import math
import random
import re
import zipfile
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.functions import scalars as S
from textloom.operators import additive, bootstrap, correlate, describe, information, metrics, relational, resample, textmeasures
from textloom.sources import readers, writers
from textloom.streaming import incremental


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def values(df, column):
    return [r[0] for r in df.select(column).collect()]


def test_safe_number_and_level(spark):
    df = frame(spark, [("3.0",), ("3.7",), ("1d",), ("nan",), ("inf",), (" 12 ",), ("",), (None,), ("1e400",), ("16",)], "v string")
    assert values(df, S.safe_number(F.col("v"))) == [3.0, 3.7, None, None, None, 12.0, None, None, None, 16.0]
    assert values(df, S.level(F.col("v"))) == [3, None, None, None, None, 12, None, None, None, None]


def test_names(spark):
    df = frame(spark, [("a\\b/17_cefr_b1_level_8_grade_77.txt",), ("9_cefr_A1_level_3.txt",), ("notes.txt",)], "p string")
    p = F.col("p")
    assert [tuple(r) for r in df.select(S.id_of_name(p), S.band_of_name(p), S.level_of_name(p)).collect()] == [("17", "B1", 8), ("9", "A1", 3), (None, None, None)]


def test_covered_union(spark):
    df = frame(spark, [([(1, 3), (2, 5), (5, 6), (9, 9), (8, 10)],), ([],)], "s array<struct<start long, stop long>>")
    assert values(df, S.covered(F.col("s"))) == [7, 0]


def test_split_is_the_hash_of_the_learner(spark):
    import hashlib

    ids = list(range(500))
    got = {r["id"]: (r["s"], r["x"]) for r in spark.range(500).select("id", S.split_share(F.col("id")).alias("s"), S.split_of(F.col("id")).alias("x")).collect()}
    for i in ids:
        s = int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:16], 16) / 2**64
        assert got[i] == (s, "train" if s < 0.7 else "validation" if s < 0.85 else "test")


def test_corrected_t_golden(spark):
    d = [0.01, 0.02, 0.015, 0.012]
    r = metrics.corrected_t(frame(spark, [(x,) for x in d], "d double"), 900, 100).first()
    assert math.isclose(r["mean"], 0.01425) and r["df"] == 3
    assert math.isclose(r["t"], 0.01425 / math.sqrt((1 / 4 + 100 / 900) * np.var(d, ddof=1)))
    assert metrics.corrected_t(frame(spark, [(0.0,)] * 4, "d double"), 900, 100).first()["t"] == 0 and metrics.t_tail(0, 3) == 1.0
    assert math.isclose(metrics.t_tail(2.0, 10), 0.0733880348, rel_tol=1e-8) and math.isclose(metrics.t_tail(1.0, 1), 0.5, rel_tol=1e-9)


def test_macro_f1_counts_labels_without_rows(spark):
    df = frame(spark, [(1, 1), (1, 2), (2, 2)], "a int, p int")
    r = metrics.overall_scores(metrics.confusion(df, "a", "p", [1, 2, 3]), 3).first()
    assert math.isclose(r["macro_f1"], (2 / 3 + 2 / 3 + 0) / 3) and math.isclose(r["accuracy"], 2 / 3)
    per = {x["label"]: x for x in metrics.class_scores(metrics.confusion(df, "a", "p", [1, 2, 3])).collect()}
    assert per[3]["accuracy"] is None and per[3]["f1"] == 0


def test_kappa_undefined_for_one_class(spark):
    df = frame(spark, [(1, 1), (1, 1)], "a int, p int")
    assert metrics.overall_scores(metrics.confusion(df, "a", "p", [1, 2]), 2).first()["qwk"] is None


def test_weighted_draws_equal_repeated_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, i // 3, int(rng.integers(1, 5)), int(rng.integers(1, 5))) for i in range(90)]
    df = frame(spark, rows, "text_id long, learner_id long, level int, predicted int")
    w = resample.bootstrap_weights(df, 3, 1)
    cells = resample.bootstrap_cells(df, w, "level", "predicted").collect()
    weight = {(r["draw"], r["learner_id"]): r["weight"] for r in w.collect()}
    assert all(sum(v for (d, _), v in weight.items() if d == k) == 30 for k in range(3))
    want = Counter()
    for d in range(3):
        for _, learner, a, p in rows:
            want[d, a, p] += weight.get((d, learner), 0)
    assert {(r["draw"], r["actual"], r["predicted"]): r["n"] for r in cells} == {k: v for k, v in want.items() if v}


def test_bootstrap_weights_repeat_and_mean_one(spark):
    ids = spark.range(400).select(F.col("id").alias("learner_id"))
    a = resample.bootstrap_weights(ids, 50)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, resample.bootstrap_weights(ids.repartition(5), 50).collect()))
    assert abs(a.agg(F.sum("weight")).first()[0] / (400 * 50) - 1) < 0.05


def test_folds_are_disjoint_and_even(spark):
    rows = [(i, i // 2, i % 15 + 1) for i in range(1800)]
    folds = resample.grouped_folds(frame(spark, rows, "text_id long, learner_id long, level int"), 10)
    size = {r["fold"]: r["n"] for r in folds.groupBy("fold").agg(F.count("*").alias("n")).collect()}
    assert folds.count() == 900 == folds.select("learner_id").distinct().count()
    assert len(size) == 10 and max(size.values()) - min(size.values()) <= 10


def test_task_folds(spark):
    rows = [(t, 1 if t <= 8 else 2) for t in range(1, 17)] * 2
    got = {(r["fold"], r["topic"]) for r in resample.task_folds(frame(spark, rows, "topic int, level int")).collect()}
    assert {t for f, t in got if f == 1} == {1, 9} and len(got) == 16


def test_fifths_equal_quantile_cuts(spark):
    import pandas as pd

    for n in (1, 2, 7, 12, 23, 100):
        df = frame(spark, [(1, i, i) for i in range(n)], "g int, v int, t int")
        got = [r["fifth"] for r in metrics.fifths(df, "g", "v", "t").orderBy("v").collect()]
        want = [1] if n == 1 else (pd.qcut(np.arange(n), 5, labels=False, duplicates="drop") + 1).tolist()
        assert got == want


def test_spearman_with_ties_and_nulls(spark):
    import pandas as pd

    rng = np.random.default_rng(1)
    rows = [("f", i, int(rng.integers(1, 6)), None if i % 9 == 0 else float(rng.integers(0, 8))) for i in range(300)] + [("c", i, i % 3 + 1, 1.0) for i in range(9)]
    r = {x["feature"]: x for x in correlate.correlations(frame(spark, rows, "feature string, text_id long, level int, value double")).collect()}
    p = pd.DataFrame([x for x in rows if x[0] == "f"], columns=["f", "i", "level", "value"]).dropna()
    assert math.isclose(r["f"]["spearman"], p["level"].rank().corr(p["value"].rank()), abs_tol=1e-12) and math.isclose(r["f"]["pearson"], p["level"].corr(p["value"]), abs_tol=1e-12)
    assert r["c"]["pearson"] is None and r["c"]["spearman"] is None and r["c"]["n"] == 9


def unsettled(spark):
    """Values whose last digit is another one each time they are made, like sums of doubles on several executors."""
    last = F.udf(lambda x: x + random.random() * 1e-9, "double").asNondeterministic()
    rows = spark.range(600).select(F.col("id").alias("text_id"), (F.col("id") % 7).cast("int").alias("level"), last(F.col("id").cast("double")).alias("a"), (F.col("id") % 5).cast("double").alias("b"))
    return rows.unpivot(["text_id", "level"], ["a", "b"], "feature", "value")


def test_correlations_of_values_that_differ_when_made_again_keep_all_rows(spark):
    import pandas as pd

    r = {x["feature"]: x for x in correlate.correlations(unsettled(spark)).collect()}
    p = pd.DataFrame({"a": np.arange(600.0), "level": np.arange(600) % 7})
    assert r["a"]["n"] == r["b"]["n"] == 600
    assert math.isclose(r["a"]["pearson"], p["a"].corr(p["level"]), abs_tol=1e-9) and math.isclose(r["a"]["spearman"], p["a"].rank().corr(p["level"].rank()), abs_tol=1e-9)


def test_ranks_of_values_that_differ_when_made_again_are_of_all_rows(spark):
    got = {(r["feature"], r["text_id"]): r["value"] for r in correlate.rank_values(unsettled(spark)).collect()}
    assert got == {("a", i): i + 1.0 for i in range(600)} | {("b", i): i % 5 * 120 + 60.5 for i in range(600)}


def test_false_discovery(spark):
    p = [0.01, 0.04, 0.03, 0.2, None, 0.03]
    got = {r["i"]: r["q"] for r in correlate.benjamini_hochberg(frame(spark, list(enumerate(p)), "i int, p double")).collect()}
    some = sorted((x, i) for i, x in enumerate(p) if x is not None)
    best, want = 1.0, {4: None}
    for k in range(len(some), 0, -1):
        best = min(best, some[k - 1][0] * len(some) / k)
        want[some[k - 1][1]] = best
    assert all((got[i] is None) == (want[i] is None) and (want[i] is None or math.isclose(got[i], want[i])) for i in want)


def test_p_value(spark):
    df = frame(spark, [(0.5, 30), (1.0, 30), (0.5, 3), (None, 30)], "r double, n long")
    got = values(df, correlate.p_value(F.col("r"), F.col("n")))
    assert math.isclose(got[0], math.erfc(math.atanh(0.5) * math.sqrt(27) / math.sqrt(2))) and got[1:] == [0.0, None, None]


def test_near_duplicate_features(spark):
    pairs = frame(spark, [("a", "b", 0.99), ("b", "c", 0.99), ("a", "c", 0.5)], "a string, b string, r double")
    assert correlate.prune_near_duplicates(pairs, ["a", "b", "c"]) == ["a", "c"]


def test_gain_of_a_clean_split(spark):
    rows = [("f", i, 1 if i < 40 else 2, float(i)) for i in range(100)] + [("k", i, i % 2, 1.0) for i in range(100)]
    got = {r["feature"]: r for r in information.information_gain(frame(spark, rows, "feature string, text_id long, level int, value double")).collect()}
    h = -(0.4 * math.log2(0.4) + 0.6 * math.log2(0.6))
    assert math.isclose(got["f"]["gain"], h, abs_tol=1e-9) and got["f"]["threshold"] == 39.5 and math.isclose(got["f"]["normalised"], 1, abs_tol=1e-9)
    assert got["k"]["gain"] == 0 and got["k"]["threshold"] is None


def test_merged_ranking_ranks_every_feature_by_both(spark, sf):
    from textloom.plans import statistics
    from textloom.plans.registry import QUERIES

    def gain(x, y):
        h = lambda v: -sum(c / len(v) * math.log2(c / len(v)) for c in Counter(v.tolist()).values())
        order = np.argsort(x, kind="stable")
        x, y = x[order], y[order]
        least = max(2, math.ceil(0.005 * len(x)))
        return max((h(y) - i / len(x) * h(y[:i]) - (len(x) - i) / len(x) * h(y[i:]) for i in range(least, len(x) - least + 1) if x[i] > x[i - 1]), default=0.0)

    got = {r["feature"]: r for r in QUERIES["e25_g03_merged_ranking"](spark, sf).collect()}
    wide = [r for r in statistics.frame(spark, sf).collect()]
    assert set(got) == set(statistics.FEATURES)
    for f in statistics.FEATURES:
        x, y = (np.array([r[c] for r in wide if r[f] is not None]) for c in (f, "level"))
        assert math.isclose(got[f]["ig"], gain(x.astype(float).round(6), y), abs_tol=2e-6)
    by = sorted(got.values(), key=lambda r: -r["ig"])
    assert [r["ig_rank"] for r in by] == list(range(1, 7))


def test_neighbour_information_tells_signal_from_noise(spark):
    rng = np.random.default_rng(0)
    rows = [("signal", i, i % 3, i % 3 + rng.normal() / 10) for i in range(600)] + [("noise", i, i % 3, rng.normal()) for i in range(600)] + [("flat", i, i % 3, 1.0) for i in range(600)]
    got = {r["feature"]: r for r in information.neighbour_information(frame(spark, rows, "feature string, text_id long, level int, value double")).collect()}
    assert abs(got["signal"]["mi"] - math.log(3)) < 0.05 and got["noise"]["mi"] < 0.06 and got["flat"]["mi"] == 0


def neighbours_by_hand(x, y, k=3):
    """Ross's estimator by comparing every pair of rows."""
    psi = lambda n: sum(1 / i for i in range(1, int(n))) - 0.5772156649015329
    use = [i for i in range(len(x)) if (y == y[i]).sum() > 1]
    parts = []
    for i in use:
        own = y == y[i]
        kk = min(k, own.sum() - 1)
        d = np.sort(np.abs(x[own] - x[i]))[kk]
        m = sum(abs(x[j] - x[i]) < d or x[j] == x[i] for j in use)
        parts.append(psi(kk) - psi(own.sum()) - psi(max(1, m)))
    return max(0.0, psi(len(use)) + np.mean(parts)) if use and x.min() < x.max() else 0.0


def test_neighbour_information_equals_all_pairs(spark):
    rng = np.random.default_rng(7)
    made = {
        "smooth": lambda i: i % 4 + rng.normal(), "tied": lambda i: float((i % 4 + rng.integers(0, 9)) // 2), "tenths": lambda i: (i % 4 - rng.integers(0, 30)) / 10,
        "wide": lambda i: (i % 4 + 1) * 10.0 ** rng.integers(-12, 12) * rng.choice([-1, 1]), "flat": lambda i: 2.0,
    }
    rows = [(f, i, 99 if i == 5 else 50 if i in (6, 7) else i % 4, float(v(i))) for f, v in made.items() for i in range(240)]
    got = {r["feature"]: r for r in information.neighbour_information(frame(spark, rows, "feature string, text_id long, level int, value double")).collect()}
    for f in made:
        x, y = (np.array([r[c] for r in rows if r[0] == f]) for c in (3, 2))
        assert got[f]["n"] == 240 and math.isclose(got[f]["mi"], neighbours_by_hand(x, y), abs_tol=1e-9)


def test_neighbour_information_of_many_rows_is_of_all(spark):
    long = spark.range(210_000).selectExpr("'f' as feature", "id as text_id", "cast(id % 2 as int) as level", "cast(id + 1000000 * (id % 2) as double) as value")
    r = information.neighbour_information(long).first()
    assert r["n"] == 210_000 and math.isclose(r["mi"], math.log(2), abs_tol=1e-3)


def test_tolerant_rank_keeps_the_first_of_a_run_as_anchor(spark):
    df = frame(spark, [("a", 1.0), ("b", 1.0 - 5e-10), ("c", 1.0 - 1.5e-9), ("d", 0.5)], "feature string, score double")
    assert {r["feature"]: r["rank"] for r in information.tolerant_rank(df).collect()} == {"a": 1, "b": 1, "c": 3, "d": 4}


def test_group_contribution_adds_before_size(spark):
    df = frame(spark, [(1, "f", "g", "o", 2.0), (1, "h", "g", "o", -2.0)], "text_id long, feature string, source string, output string, score double")
    assert metrics.contributions(df, "source").first()["mean_absolute"] == 0 and metrics.contributions(df).agg(F.avg("mean_absolute")).first()[0] == 2


def test_stability_counts_absent_folds_as_zero(spark):
    df = frame(spark, [(0, "a", 4.0), (1, "a", 4.0), (0, "b", 1.0)], "fold int, feature string, importance double")
    got = {r["feature"]: r for r in metrics.stability(df, 4, 1).collect()}
    assert got["a"]["mean"] == 2 and math.isclose(got["a"]["sd"], np.std([4, 4, 0, 0], ddof=1)) and got["b"]["folds_in_top"] == 0


def test_progression(spark):
    use = [(0, 0, 50, 60, 70), (0, 60, 10, 0, 0)]
    rows = [(f"f{k}", i + 1, float(v), "sufficient") for k, u in enumerate(use) for i, v in enumerate(u)]
    got = {r["feature"]: r for r in describe.progression(frame(spark, rows, "feature string, level int, prevalence double, evidence string"), 50).collect()}
    assert (got["f0"]["first_common"], got["f0"]["sustained_from"], got["f0"]["drops"]) == (3, 3, 0)
    assert (got["f1"]["first_common"], got["f1"]["sustained_from"], got["f1"]["drops"]) == (2, None, 3)


def test_checks_raise(spark):
    df = frame(spark, [(1, 2), (1, 3)], "text_id long, x int")
    with pytest.raises(ValueError):
        relational.unique(df, "text_id")
    with pytest.raises(ValueError):
        relational.wide([df, df])
    with pytest.raises(ValueError):
        readers.header(["a", "A "])


def test_additive_model_learns_and_decomposes(spark):
    rng = np.random.default_rng(0)
    x = rng.random(600)
    rows = [("m", i, float(v), None if i % 7 == 0 else float(rng.random()), "hi" if v > 0.5 else "lo", float(3 * v)) for i, v in enumerate(x)]
    df = frame(spark, rows, "model string, text_id long, a double, b double, y string, z double")
    terms = additive.fit(df, ["a", "b"], "y", "classifier", rounds=40, bins=16).cache()
    p = additive.predict(df, ["a", "b"], terms)
    sums = p.groupBy("text_id").agg(F.sum("probability").alias("s"), F.max_by("output", "probability").alias("best"))
    assert sums.where(F.abs(F.col("s") - 1) > 1e-9).count() == 0
    assert sums.join(df, "text_id").agg(F.avg((F.col("best") == F.col("y")).cast("double"))).first()[0] > 0.97
    mean = additive.contributions(df, ["a", "b"], terms).groupBy("feature", "output").agg(F.avg("score").alias("m"))
    assert mean.where(F.abs("m") > 1e-6).count() == 0
    reg = additive.predict(df, ["a", "b"], additive.fit(df, ["a", "b"], "z", "regressor", rounds=120, bins=32))
    assert reg.join(df, "text_id").agg(F.avg(F.abs(F.col("score") - F.col("z")))).first()[0] < 0.12
    assert additive.dummy(df, "y", "classifier").where("score = 1").first()["output"] in ("hi", "lo")


@pytest.mark.parametrize("kind", ["regressor", "classifier"])
def test_models_from_counts_of_all_tasks_equal_those_of_one(spark, monkeypatch, kind):
    rng = np.random.default_rng(7)
    x, y = rng.random((900, 2)).round(2), rng.integers(0, 3, 900)
    rows = [(f"m{i % 2}", i, float(a + t), None if i % 7 == 0 else float(b), 1.5, int(t)) for i, ((a, b), t) in enumerate(zip(x, y, strict=True))]
    df = frame(spark, rows, "model string, text_id long, a double, `b.c` double, flat double, y long").repartition(5)
    sets = {"both": ["a", "b.c", "flat"], "one": ["b.c"]}
    monkeypatch.setattr(additive, "BLOCK", 50)

    def terms(**more):
        return {(r["model"], r["feature"], r["bin"], r["output"]): (r["low"], r["score"]) for r in additive.fit(df, ["a", "b.c", "flat"], "y", kind, rounds=12, bins=8, **more).collect()}

    for more in ({}, {"sets": sets}):
        monkeypatch.setattr(additive, "TASK_VALUES", 10**9)
        want = terms(**more)
        monkeypatch.setattr(additive, "TASK_VALUES", 0)
        got = terms(**more)
        assert got.keys() == want.keys() and len({m for m, *_ in got}) == 2
        for key, (low, score) in want.items():
            assert got[key] == (low if low is None else pytest.approx(low), pytest.approx(score, abs=1e-9)), key


@pytest.mark.parametrize("way", ["together", "jobs"])
def test_a_classifier_of_many_rows_by_tasks_that_hold_their_cells(spark, monkeypatch, way):
    """Several tasks and stages give the steps of one task; the number of jobs doesn't grow with the rounds."""
    rng = np.random.default_rng(3)
    rows = [(i, float(a), None if i % 5 == 0 else float(b), "abc"[int(t)]) for i, (a, b, t) in enumerate(zip(rng.random(700).round(2), rng.random(700), rng.integers(0, 3, 700), strict=True))]
    df = frame(spark, rows, "text_id long, a double, b double, y string").repartition(3)
    sets = {"both": ["a", "b"], "one": ["b"], "none": []}

    def fitted(rounds):
        name = f"{way}-{rounds}-{additive.TASK_VALUES}"
        spark.sparkContext.setJobGroup(name, name)
        found = additive.fit(df, ["a", "b"], "y", "classifier", rounds, 8, sets).collect()
        return {(r["model"], r["feature"], r["bin"], r["output"]): r["score"] for r in found}, len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))

    want, _ = fitted(10)
    for name, value in (("TASK_VALUES", 0), ("TASK_CELLS", 100), ("STATE", 1), ("BLOCK", 64)):
        monkeypatch.setattr(additive, name, value)
    if way == "jobs":
        monkeypatch.setattr(additive.files, "mounted", lambda *_: None)
    got, jobs = fitted(10)
    assert got.keys() == want.keys() and {m for m, *_ in got} == set(sets)
    assert got == {k: pytest.approx(v, abs=1e-9) for k, v in want.items()}
    assert way == "jobs" or jobs == fitted(4)[1]


def test_smoothing_rounds_step_by_few_runs_of_bins():
    rng = np.random.default_rng(2)
    x = rng.random((500, 1))
    x[::9] = np.nan
    y = np.nan_to_num(3 * x[:, 0], nan=7)

    def scores(**more):
        t = additive.fit_arrays(x, y, ["a"], None, bins=32, **more)
        return t[(t["feature"] == "a") & (t["bin"] > 0)]["score"].round(12).nunique()

    assert scores(rounds=4) > additive.LEAVES
    assert scores(rounds=1, smoothing=1) == additive.LEAVES < scores(rounds=1, smoothing=0)
    flat = np.full((30, 1), 2.0)
    assert len(additive.fit_arrays(flat, y[:30], ["a"], None, rounds=8))


@pytest.mark.parametrize("name", ["k01_k03_additive_classifier", "k01_additive_regressor", "k06_models_of_all_feature_sets", "j06_transfer_to_unseen_tasks", "e44_e45_e46_bootstrap_accuracy"])
def test_queries_run_the_whole_operator(spark, sf, monkeypatch, name):
    """200 rounds and 128 bins of a model, 2,000 draws of a bootstrap."""
    from textloom.plans import pipelines, statistics  # noqa: F401
    from textloom.plans.registry import QUERIES

    seen = []

    def noted(f):
        def run(*args, **more):
            bound = inspect.signature(f).bind(*args, **more)
            bound.apply_defaults()
            seen.append({k: bound.arguments[k] for k in ("rounds", "bins", "draws") if k in bound.arguments})
            return f(*args, **more)

        return run

    monkeypatch.setattr(additive, "fit", noted(additive.fit))
    monkeypatch.setattr(bootstrap, "run_draws", noted(bootstrap.run_draws))
    QUERIES[name](spark, sf)
    assert seen == [{"draws": 2000}] if name.startswith("e44") else seen == [{"rounds": 200, "bins": 128}]


def test_text_measures(spark):
    df = frame(spark, [(1, "The cat. The dog!\n- one\n2) " + "w " * 100), (2, ""), (3, None)], "doc_id long, text string")
    c = textmeasures.chunks(df).where("doc_id = 1").orderBy("sentence", "chunk").collect()
    assert [r["words"] for r in c] == [2, 2, 1, 45, 45, 10]
    assert values(frame(spark, [("a [x] b (y)\n12: c   d \n\n e",)], "t string"), textmeasures.clean(F.col("t"))) == ["a b\nc d\ne"]
    e = textmeasures.align(frame(spark, [(1, "a b c", "a x c d"), (2, "s", "s")], "text_id long, original string, corrected string"))
    got = {r["text_id"]: [(x["operation"], x["start"], x["stop"]) for x in r["edits"]] for r in e.collect()}
    assert got == {1: [("R", 1, 2), ("M", 3, 3)], 2: []}


def test_alignment_equals_difflib(monkeypatch):
    rng = np.random.default_rng(5)
    monkeypatch.setattr(textmeasures._Matcher, "STEPS", 0)
    for n in (0, 1, 2, 5, 20, 60, 120):
        for letters in ("a", "ab", "abcdefgh"):
            for _ in range(20):
                a = list(rng.choice(list(letters), n))
                b = [x for x in a if rng.random() > 0.2] if rng.random() < 0.7 else list(rng.choice(list(letters), n + 3))
                assert textmeasures._Matcher(None, a, b, autojunk=False).get_opcodes() == difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes()


def test_word_edits_of_long_texts(spark, sf):
    from textloom.plans import statistics  # noqa: F401
    from textloom.plans.registry import QUERIES

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    changed = {r["doc_id"] for r in docs if r["text"] and re.search(r"\b(of|le|der) ", r["text"])}
    assert any(len(r["text"]) >= 3000 for r in docs if r["doc_id"] in changed)
    assert set(values(QUERIES["l06_word_edits"](spark, sf), "text_id")) == changed


def test_files(spark, tmp_path):
    d = str(tmp_path)
    for name, raw in (("1_cefr_A1_level_2_grade_5.txt", "﻿hé\0llo".encode()), ("2_cefr_B2_level_11_grade_9.txt", "né".encode("cp1252")), ("3_cefr_C1_level_13_grade_1.txt", "wide".encode("utf-16"))):
        (tmp_path / name).write_bytes(raw)
    got = {r["writing_id"]: (r["cefr_level"], r["level"], r["text"]) for r in readers.read_text_files(spark, d).collect()}
    assert got == {"1": ("A1", 2, "hé llo"), "2": ("B2", 11, "né"), "3": ("C1", 13, "wide")}
    counts = describe.histogram(readers.list_names(spark, d), F.lit(1)).first()["n"]
    assert counts == 3
    df = frame(spark, [("1", "A1", "x, \"y\"\n& <z>"), ("2", None, "é")], "writing_id string, cefr string, text string")
    writers.write_xlsx(df, d + "/t.xlsx")
    assert sorted(map(tuple, readers.read_xlsx(spark, d + "/t.xlsx", ["writing_id", "cefr", "text"]).collect())) == sorted(map(tuple, df.collect()))
    with zipfile.ZipFile(d + "/t.xlsx") as z:
        assert b"hidden" in z.read("xl/workbook.xml")
    writers.write_report_csv(df, d + "/t.csv")
    assert (tmp_path / "t.csv").read_bytes().startswith(b"\xef\xbb\xbfwriting_id,cefr,text\n")
    (tmp_path / "m.csv").write_text("Text_ID , level\n1.0,3\n2,4\n")
    assert [tuple(r) for r in readers.read_metadata(spark, d + "/m.csv", ["text_id", "level"], ["text_id", "level"]).collect()] == [(1, 3), (2, 4)]
    (tmp_path / "bad.csv").write_text("text_id,level\n1,3\n1,x\n")
    with pytest.raises(ValueError):
        readers.read_metadata(spark, d + "/bad.csv", ["text_id", "level"], ["text_id", "level"])
    writers.write_manifest({"t": df}, d + "/m.json")
    assert writers.verify_manifest({"t": df.repartition(2)}, d + "/m.json") == [] and writers.verify_manifest({"t": df.limit(1)}, d + "/m.json") == ["t"]
    assert json.loads((tmp_path / "m.json").read_text())["t"]["columns"] == ["writing_id", "cefr", "text"]
    n = frame(spark, [("A1", 1, 5), ("A1", 2, 6), ("B1", 7, 1)], "cefr_level string, level int, n int")
    writers.write_counts_xml(n, d + "/c.xml")
    assert 'name="A1" count="11"' in (tmp_path / "c.xml").read_text()
    assert writers.markdown(n).splitlines()[2] == "| A1 | 1 | 5 |" and r"A1 & 1 & 5 \\" in writers.latex(n)


def test_streams(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "id long, ts timestamp, level int"
    rows = spark.range(20).select((F.col("id") % 15).alias("id"), F.expr("timestamp'2024-01-01' + make_interval(0,0,0,0,0,id)").alias("ts"), (F.col("id") % 3).cast("int").alias("level"))
    rows.coalesce(1).write.parquet(src)
    s = incremental.first_seen(incremental.rows_of(spark, src, schema), "id", "ts")
    incremental.process(s, lambda df: df, out, out + "-failed", str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(out).count() == 15
    rows.limit(3).write.mode("append").parquet(src)
    incremental.process(incremental.rows_of(spark, src, schema), lambda df: df.selectExpr("no_such"), out, out + "-failed", str(tmp_path / "cp2")).awaitTermination()
    assert spark.read.parquet(out + "-failed").count() == 23
    bad = lambda df: df.select("id", F.when((F.col("id") == 4) & (F.col("level") == 1), F.raise_error(F.lit("four"))).otherwise(F.lit("ok")).alias("said"))
    incremental.process(incremental.rows_of(spark, src, schema), bad, out + "3", out + "3-failed", str(tmp_path / "cp3")).awaitTermination()
    aside = spark.read.parquet(out + "3-failed").collect()
    assert {(r["id"], r["level"], r["tries"]) for r in aside} == {(4, 1, 3)} and all("four" in r["reason"] for r in aside)
    assert spark.read.parquet(out + "3").count() + len(aside) == 23
    q = incremental.running_counts(incremental.rows_of(spark, src, schema), ["level"]).writeStream.outputMode("complete").format("memory").queryName("levels").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("levels").agg(F.sum("n")).first()[0] == 23


def test_any_number_of_failing_rows_are_set_aside_one_by_one(spark, tmp_path):
    """More faults than ``process`` looks for one by one."""
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.range(2000).selectExpr("id", "if(id % 3 = 0, null, id / 2) as half").write.parquet(src)

    def work(rows):
        if (rows["id"] % 10 == 7).any():
            raise ValueError("seven")
        return rows

    incremental.process_rows(incremental.rows_of(spark, src, "id long, half double"), work, "id long, half double", out, out + "-failed", str(tmp_path / "cp"), 2).awaitTermination()
    done, lost = spark.read.parquet(out), spark.read.parquet(out + "-failed")
    assert sorted(values(done, "id")) == [i for i in range(2000) if i % 10 != 7]
    assert done.where("half <=> if(id % 3 = 0, null, id / 2)").count() == 1800
    assert sorted(values(lost, "id")) == list(range(7, 2000, 10))
    assert {(r["tries"], r["reason"]) for r in lost.collect()} == {(2, "seven")}


def test_places_of_predictions_hold_however_frames_are_cut(spark, monkeypatch):
    """Each use of a sorted frame may be cut to ranges of its own."""
    from textloom.plans import files as plans
    from textloom.sources import readers

    rows = frame(spark, [(i, "A1", "A1") for i in range(1, 400)], "text_id long, cefr_level string, predicted_cefr string")
    monkeypatch.setattr(plans, "predictions", lambda spark, sf: rows)
    real = readers.read_predictions
    monkeypatch.setattr(readers, "read_predictions", lambda spark, path: real(spark, path).repartition(7))
    got = {r["text_id"]: r["place"] for r in plans.p27(spark, "").collect()}
    assert got == {i: i for i in range(1, 400)}


def test_gain_has_no_row_for_each_value_and_class(spark):
    long = frame(spark, [("f", float(i), i % 5) for i in range(60)], "feature string, value double, level int")
    gain = information.information_gain(long)
    assert gain._jdf.queryExecution().optimizedPlan().toString().count("Join ") <= 4
    assert gain.first()["n"] == 60


def test_correlation_summary_reads_its_tests_once(spark, monkeypatch):
    from textloom.sources import reports

    calls, real = [], reports.small
    monkeypatch.setattr(reports, "small", lambda df: calls.append(1) or real(df))
    rows = frame(spark, [("b", 0.9, "very strong", 0.01), ("a", 0.9, "very strong", 0.2), ("c", -0.3, "weak", 0.01), ("d", None, None, None)], "feature string, spearman double, strength string, q double")
    lines = reports.correlation_summary(rows)
    assert len(calls) == 1
    assert [x for x in lines if ". " in x] == ["1. a: 0.9000", "2. b: 0.9000", "1. c: -0.3000"]
    assert {"very strong: 2", "weak: 1", "not calculable: 1", "significant: 2"} <= set(lines)


def test_alignment_takes_few_texts_at_a_time(spark, monkeypatch):
    pairs = frame(spark, [(i, f"a b{i % 3} c", "a b1 c d") for i in range(7)] + [(7, None, "x")], "text_id long, original string, corrected string").coalesce(1)
    want = textmeasures.align(pairs).collect()
    monkeypatch.setattr(textmeasures, "ALIGNED", 2)
    assert textmeasures.align(pairs).collect() == want and [len(r["edits"]) for r in want] == [2, 1, 2, 2, 1, 2, 2, 1]
