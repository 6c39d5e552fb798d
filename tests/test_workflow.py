"""The command surface, the context of stored scores, running sums, and files through any file system."""

import io
import math
import zipfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from textloom import __main__ as command
from textloom import workflow
from textloom.functions import ranges
from textloom.operators import bootstrap, context, correlate, information, metrics, relational, resample
from textloom.sources import files, readers, reports, writers


def test_running_sums_and_next_values(spark):
    rng = np.random.default_rng(3)
    values = np.unique(np.concatenate([rng.normal(0, 1000, 300), rng.normal(0, 1e-9, 50), [0.0, 8.0, -8.0, 7.999999999999999, 2.0**-30, 1e300, -1e300, 4.0, 1024.0], np.arange(-20, 20)]))
    rows = [(g, float(v), int(rng.integers(1, 9))) for g in "ab" for v in values[:: 1 if g == "a" else 3]]
    df = spark.createDataFrame(rows, "g string, v double, c long").repartition(5)
    got = {(r["g"], r["v"]): r for r in ranges.running(df, ["g"], "v", ["c"]).collect()}
    nxt = {(r["g"], r["v"]): r["after"] for r in ranges.following(df.select("g", "v"), ["g"], "v", "after").collect()}
    for g in "ab":
        own = sorted(r for r in rows if r[0] == g)
        upto = np.cumsum([r[2] for r in own])
        for i, r in enumerate(own):
            assert (got[g, r[1]]["c_upto"], got[g, r[1]]["c_all"]) == (upto[i], upto[-1])
            assert nxt[g, r[1]] == (own[i + 1][1] if i + 1 < len(own) else None)


def test_ranges_never_fall(spark):
    x = np.unique(np.concatenate([2.0 ** np.arange(-40, 40), np.nextafter(2.0 ** np.arange(-40, 40), 0), -(2.0 ** np.arange(-40, 40)), np.random.default_rng(1).normal(0, 100, 500), [0.0]]))
    df = spark.createDataFrame(pd.DataFrame({"x": x})).select("x", ranges.range_of(F.col("x")).alias("r"))
    r = [row["r"] for row in df.orderBy("x").collect()]
    assert r == sorted(r)


def test_quantile_edges_are_exact(spark):
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(50, 20, 777), 1)
    long = spark.createDataFrame([("f", float(v), int(v > 50)) for v in x], "feature string, value double, level int")
    edges = np.unique(np.quantile(x, np.arange(21) / 20))[1:-1]
    got = sorted((r["value"], r["bin"]) for r in information.quantile_bins(long).collect())
    assert [b for _, b in got] == [1 + int(np.searchsorted(edges, v + 1e-9)) for v, _ in got]


def test_pair_correlations_against_numpy(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(1e6, 1, (200, 4))
    x[:, 2] = 7.0
    x[rng.random((200, 4)) < 0.3] = np.nan
    rows = [(i, f"f{j}", float(x[i, j])) for i in range(200) for j in range(4) if not math.isnan(x[i, j])]
    got = {(r["a"], r["b"]): r for r in correlate.pair_correlations(spark.createDataFrame(rows, "text_id long, feature string, value double").repartition(3)).collect()}
    for i in range(4):
        for j in range(i + 1, 4):
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            r = got[f"f{i}", f"f{j}"]
            assert r["n"] == both.sum()
            assert r["r"] is None if 2 in (i, j) else math.isclose(r["r"], np.corrcoef(x[both, i], x[both, j])[0, 1], abs_tol=1e-9)


def test_bootstrap_equals_expanded_samples(spark):
    """Scores of weighted cells are those of the rows repeated as often as the draw has their learner."""
    rng = np.random.default_rng(3)
    level = rng.integers(1, 16, 90)
    guess = np.clip(level + rng.integers(-2, 3, 90), 1, 15)
    rows = pd.DataFrame({"text_id": np.arange(90), "learner_id": np.arange(90) // 3, "level": level, "predicted": guess})
    df = spark.createDataFrame(rows)
    weights = resample.bootstrap_weights(df, 6)
    w = weights.toPandas()
    assert (w.groupby("draw")["weight"].sum() == 30).all()
    cells = resample.bootstrap_cells(df, weights, "level", "predicted").toPandas()
    for d in range(6):
        own = w[w["draw"] == d].set_index("learner_id")["weight"]
        sample = rows.loc[np.repeat(rows.index, rows["learner_id"].map(own).fillna(0).astype(int))]
        want = sample.groupby(["level", "predicted"]).size()
        got = cells[cells["draw"] == d].set_index(["actual", "predicted"])["n"]
        assert want.to_dict() == got.to_dict()


def test_bootstrap_blocks_are_multinomial(spark, monkeypatch):
    monkeypatch.setattr(bootstrap, "BLOCK", 16)
    ids = spark.range(200).withColumnRenamed("id", "learner_id")
    w = resample.bootstrap_weights(ids, 300).toPandas()
    assert (w.groupby("draw")["weight"].sum() == 200).all()
    counts = w.pivot_table(index="draw", columns="learner_id", values="weight", fill_value=0).to_numpy()
    assert abs(counts.mean() - 1) < 1e-9 and abs(counts.var() - (1 - 1 / 200)) < 0.03


def test_neighbours_across_ranges(spark, monkeypatch):
    monkeypatch.setattr(ranges, "STEPS", 4)
    rng = np.random.default_rng(8)
    rows = [(g, float(v), i) for g in "ab" for i, v in enumerate(np.unique(np.round(rng.normal(size=300) * 10.0 ** rng.integers(-3, 4, 300), 4)))]
    df = spark.createDataFrame(rows + [("c", 1.0, 5)], "g string, value double, c long")
    got = {(r["g"], r["value"]): sorted((x["d"], x["c"]) for x in r["near"]) for r in ranges.neighbours(df, ["g"], "value", "c", 3).collect()}
    for g in "abc":
        own = [(v, c) for h, v, c in rows + [("c", 1.0, 5)] if h == g]
        for i, (v, _) in enumerate(own):
            assert got[g, v] == sorted((abs(v - x), c) for x, c in own[max(0, i - 3) : i] + own[i + 1 : i + 4])
    assert len(got) == len(rows) + 1


def test_corrected_t(spark):
    d = spark.createDataFrame([(x,) for x in (0.01, 0.02, 0.015, 0.012)], "d double")
    r = metrics.corrected_t(d, 900, 100).withColumn("p", metrics.t_p(F.col("t"), F.col("df"))).first()
    t = 0.01425 / math.sqrt((1 / 4 + 100 / 900) * np.var([0.01, 0.02, 0.015, 0.012], ddof=1))
    u = t / math.sqrt(3)
    assert math.isclose(r["mean"], 0.01425) and math.isclose(r["t"], t)
    assert math.isclose(r["p"], 1 - 2 / math.pi * (math.atan(u) + u / (1 + u * u)), rel_tol=1e-9)
    zero = metrics.corrected_t(spark.createDataFrame([(0.0,)] * 4, "d double"), 900, 100).select(metrics.t_p(F.col("t"), F.col("df")).alias("p")).first()
    assert zero["p"] == 1.0


def test_settings_and_trends(spark, tmp_path):
    s = context.check_settings({})
    p = spark.createDataFrame([("a", 70.0, "sustained", 1, 2, 0), ("b", 70.0, "never observed", None, None, 0), ("a", 2.0, "sustained", 1, 1, 0)], "feature string, threshold double, status string, first_common int, sustained_from int, drops int")
    own = {**s, "min_texts_per_level": 1500, "comparison_thresholds": [2.0, 12.5]}
    lines = reports.progression_summary(p, own)
    assert "min_texts_per_level = 1500" in lines and "2%: sustained: 1" in lines
    context.put_settings(own, f"{tmp_path}/settings.json")
    assert context.settings_of(f"{tmp_path}/settings.json") == own
    files.put(f"{tmp_path}/settings.json", b'{"min_later_levels": 3}')
    assert context.settings_of(f"{tmp_path}/settings.json") == {**s, "min_later_levels": 3}
    files.put(f"{tmp_path}/settings.json", b'{"other": 3}')
    with pytest.raises(ValueError):
        context.settings_of(f"{tmp_path}/settings.json")
    for bad in ({"common_usage_percent": 0}, {"comparison_thresholds": [101]}, {"min_texts_per_level": 1.5}, {"min_later_levels": 15}, {"min_feature_coverage_percent": float("nan")}):
        with pytest.raises(ValueError):
            context.check_settings(bad)
    good = spark.createDataFrame([("Level", "1", "5", "0.5"), ("overall", None, "9", "1")], "`Group_Type ` string, level string, texts string, pooled_rate string")
    found, why = context.error_trends(good)
    assert why == "" and [tuple(r) for r in found.collect()] == [(1, 5, 0.5)]
    assert context.error_trends(good.unionAll(good))[1] and context.error_trends(good.drop("level"))[1] and context.error_trends(None)[1] and context.error_trends(good.limit(0))[1]


def test_relabel_and_annotate(spark):
    scores = spark.createDataFrame([("s", "a", 0.5, True), ("s", "b", 0.7, False), ("t", "a", 0.6, False)], "source string, feature string, score double, is_length boolean")
    got = {(r["source"], r["feature"]): (r["is_length"], r["rank"], r["rank_without_length"]) for r in context.relabel(scores, spark.createDataFrame([("S", "B")], "source string, feature string")).collect()}
    assert got == {("s", "b"): (True, 1, None), ("t", "a"): (False, 2, 1), ("s", "a"): (False, 3, 2)}


def test_merge_parts_salvages_whole_rows(spark):
    done = spark.createDataFrame([(1, "x")], "id long, v string")
    parts = [spark.createDataFrame([(1, "late"), (2, "a"), (3, "a")], "id long, v string"), spark.createDataFrame([(2, "b"), (3, None), (None, "c")], "id long, v string")]
    assert sorted(map(tuple, relational.merge_parts(done, parts, "id", ["v"]).collect())) == [(1, "x"), (2, "b"), (3, "a")]


def test_workbook_with_shared_strings(spark, tmp_path):
    """Only needed columns and their shared strings are decoded; cells may be missing."""
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    shared = f"<sst {ns}>" + "".join(f"<si><t>{x}</t></si>" for x in ("Id", " Text ", "Unused", "one", "never")) + "</sst>"
    sheet = f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>2</v></c><c r="D1" t="s"><v>1</v></c></row><row><c r="A2"><v>5</v></c><c r="C2" t="s"><v>4</v></c><c r="D2" t="s"><v>3</v></c></row><row><c r="A3"><v>6</v></c></row><row><c r="D4" t="s"><v>3</v></c></row></sheetData></worksheet>'
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", shared)
        z.writestr("xl/worksheets/sheet1.xml", sheet)
    got = readers.read_xlsx(spark, str(tmp_path / "b.xlsx"), ["id", "text"])
    assert sorted(map(tuple, got.collect())) == [("5", "one"), ("6", None)]
    with zipfile.ZipFile(io.BytesIO((tmp_path / "b.xlsx").read_bytes())) as z:
        assert readers._shared(z, {3}) == {3: "one"}
    with pytest.raises(ValueError):
        readers.read_xlsx(spark, str(tmp_path / "b.xlsx"), ["id", "missing"])


def test_files_are_whole_or_absent(spark, tmp_path):
    p = f"{tmp_path}/x.bin"
    assert not files.exists(p)
    files.put(p, b"a" * 3_000_000)
    files.put(p, b"\x00\xff")
    assert files.get(p) == b"\x00\xff" and not files.exists(p + ".tmp")
    files.put(p + ".gz", b"")
    assert readers.with_fallback(p) == p and readers.with_fallback(f"{tmp_path}/y") == f"{tmp_path}/y"


def test_stored_scores_are_checked(spark, tmp_path):
    spark.createDataFrame([("s", "1.5")], "source string, score string").write.parquet(f"{tmp_path}/s")
    assert readers.read_scores(spark, f"{tmp_path}/s", {"score": "double"}, ["s"]).first()["score"] == 1.5
    with pytest.raises(ValueError):
        readers.read_scores(spark, f"{tmp_path}/s", {"rank": "int"})


def test_workflow_from_data_to_sealed_test(spark, sf, tmp_path):
    out = f"{tmp_path}/run"
    few = ["--rounds", "4", "--bins", "8", "--top-k", "2", "--folds", "2", "--draws", "30"]
    assert command.main(["dataframe", sf, out, "--metadata-only", "--csv"]) == 0
    with pytest.raises(FileExistsError):
        command.main(["dataframe", sf, out, "--metadata-only"])
    assert command.main(["workflow", "run", sf, out, *few]) == 0
    run = workflow.Run(spark, sf, out, 4, 8, 2, 2)
    board = {(r["target"], r["model"]): r for r in run.read("leaderboard").collect()}
    assert board["cefr", "combined"]["macro_f1"] > board["cefr", "baseline"]["macro_f1"] and len(board) == 2 * 16
    before = run.read("terms-level-regressor").inputFiles()
    command.main(["workflow", "train", sf, out, *few])
    assert run.read("terms-level-regressor").inputFiles() == before  # finished models stay
    assert {r["selected"] for r in run.read("ranking").collect()} <= {"Both", "MI only", "IG only", "Neither"}
    command.main(["mi", sf, out, "--relabel", *few])
    command.main(["workflow", "final-test", sf, out, *few])
    assert run.read("final").count() == run.read("report").count()
    terms = run.read("terms-level-regressor")
    run.write("terms-level-regressor", spark.createDataFrame(terms.limit(5).collect(), terms.schema))
    with pytest.raises(ValueError):
        command.main(["workflow", "final-test", sf, out, *few])
    command.main(["tables", sf, out])
    assert "STRENGTH" in files.get(f"{out}/correlations.txt").decode()
    command.main(["validity", "length", sf, out])


def test_cross_validation_resumes(spark, sf, tmp_path):
    out = f"{tmp_path}/cv"
    run = workflow.Run(spark, sf, out, 3, 8, 2, 2)
    jobs = [j["job_id"] for j in workflow.cv_prepare(run, ["level"]).orderBy("place").collect()]
    assert len(jobs) == len(set(jobs)) == 2 * (2 * 2 + 2)
    workflow.cv_run(run, "level__regressor__length_only__0")
    assert sum(r["done"] for r in workflow.cv_status(run).collect()) == 1
    for j in ("level__regressor__length_only__1", "level__median__0", "level__median__1"):
        workflow.cv_run(run, j)
    got = {(r["model"], r["metric"]) for r in workflow.cv_summarize(run).collect()}
    assert ("length_only", "mae") in got and ("baseline", "mae") in got


def test_experiments_keep_each_others_models(spark, sf, tmp_path):
    run = workflow.Run(spark, sf, f"{tmp_path}/run", 3, 8, 2, 2, 20)
    workflow.train(run, ["level"], ["combined"])
    first = {m: n for m, n in run.read("terms-level-regressor").groupBy("model").count().collect()}
    workflow.train(run, ["level"], ["length_only"])
    both = {m: n for m, n in run.read("terms-level-regressor").groupBy("model").count().collect()}
    assert set(first) == {"combined", "baseline"} and set(both) == {"combined", "baseline", "length_only"} and both["combined"] == first["combined"]
    with pytest.raises(ValueError):
        workflow.train(run, ["level"], ["none such"])
    report = {(r["algorithm"], r["model"], r["metric"]): r for r in workflow.report(run).collect()}
    assert {m for _, _, m in report} == {"accuracy", "macro_f1", "ordinal_mae", "within_one", "qwk", "mae", "rmse", "r2", "spearman"}
    for key in (("classifier", "combined", "macro_f1"), ("regressor", "combined", "mae"), ("regressor", "combined", "spearman")):
        r = report[key]
        assert r["sd"] > 0 and r["low"] <= r["high"] and abs(r["value"] - (r["low"] + r["high"]) / 2) < 6 * r["sd"]
    assert report["regressor", "baseline", "spearman"]["value"] is None
    pairs = run.read("report-differences").collect()
    assert {(r["algorithm"], r["other"]) for r in pairs} == {(a, o) for a in ("classifier", "regressor") for o in {"combined", "baseline", "length_only"} - {r["best"] for r in pairs if r["algorithm"] == a}}
    assert run.read("report-labels").where("model = 'combined'").count() == 15
    assert run.read("report-draws").where("metric = 'mae'").count() == 3 * 20


def test_a_leaking_or_changed_split_stops_a_run(spark, sf, tmp_path, monkeypatch):
    run = workflow.Run(spark, sf, f"{tmp_path}/run")
    with monkeypatch.context() as m:
        m.setattr(workflow.resample, "with_split", lambda rows: rows.withColumn("split", F.when(F.col("text_id") % 2 == 0, "train").otherwise("test")))
        with pytest.raises(ValueError, match="learner in several splits"):
            workflow.prepare(run)
    assert not run.has("data")
    rows = workflow.prepare(run)
    changed = spark.createDataFrame(rows.withColumn("split", F.lit("train")).collect(), rows.schema)
    run.write("data", changed)
    with pytest.raises(ValueError, match="changed"):
        workflow.prepare(workflow.Run(spark, sf, f"{tmp_path}/run"))


def test_ranked_families_choose_inside_each_fold(spark, sf, tmp_path):
    run = workflow.Run(spark, sf, f"{tmp_path}/cv", 3, 8, 2, 2)
    jobs = workflow.cv_prepare(run, ["level"], ["training_information_gain_features"])
    assert jobs.count() == 2 * (2 + 2)
    for fold in range(2):
        best = workflow.fold_sets(run, fold)["training_information_gain_features"]
        train = workflow._job_rows(run, fold)[0].unpivot(["level"], run.features, "feature", "value")
        want = [r["feature"] for r in information.information_gain(train).orderBy(F.desc("gain"), "feature").limit(2).collect()]
        assert best == sorted(want)
    workflow.cv_run(run)
    assert {r["done"] for r in workflow.cv_status(run).collect()} == {4}


def test_settings_of_a_run(spark, sf):
    with pytest.raises(ValueError):
        workflow.Run(spark, sf, "/tmp/none", folds=1)


def test_summaries(spark):
    tests = spark.createDataFrame([("a", 0.5, "moderate", 0.01), ("b", -0.1, "very weak", 0.2)], "feature string, spearman double, strength string, q double")
    lines = reports.correlation_summary(tests)
    assert "significant: 1" in lines and "1. a: 0.5000" in lines and "1. b: -0.1000" in lines
    df = spark.createDataFrame([("m", 0.5, 0.1, None, 0.2)], "model string, f1 double, f1_standard_deviation double, mae double, mae_standard_deviation double")
    assert [tuple(r) for r in writers.with_deviations(df.select("model", "f1_standard_deviation", "f1", "mae_standard_deviation", "mae"), ["f1", "mae"]).collect()] == [("m", 0.5, 0.1, None, None)]
