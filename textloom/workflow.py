"""The command surface: build the frame, rank features, train, report, cross-validate and check validity, run by run.

Everything a command makes is a table or a small file in the run's folder; a command that finds what it needs there
goes on from it, so a run can be stopped and resumed anywhere.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from textloom.functions import scalars as S
from textloom.operators import additive, bootstrap, context, correlate, describe, experiments, foldranks, information, metrics, relational, resample
from textloom.sources import adapters, files, frames, readers, reports, writers

LABELS = {"level": list(range(1, S.LEVELS + 1)), "cefr": S.BANDS[:5]}
#: Of each task: the label's column and the algorithms.
TASKS = {"level": ("level", ["classifier", "regressor"]), "cefr": ("cefr_level", ["classifier"])}


class Run:
    """A run's folder, its tables and its settings. given: a frame of any columns with its dictionary, in place of the texts
    and features that the adapters make of the tables."""

    def __init__(self, spark: SparkSession, tables: str, out: str, rounds: int = additive.ROUNDS, bins: int = additive.BINS, top_k: int = 200, folds: int = 10, draws: int = 2000, given: frames.Given | None = None):
        self.draws, self.verified, self.given = draws, False, given
        self.spark, self.tables, self.out = spark, tables, out.rstrip("/")
        self.rounds, self.bins, self.top_k, self.folds = rounds, bins, top_k, folds
        if min(rounds, bins, top_k, draws) < 1 or folds < 2:
            raise ValueError("rounds, bins, top_k and draws are at least 1, folds at least 2")

    def path(self, name: str) -> str:
        return f"{self.out}/{name}"

    def has(self, name: str) -> bool:
        return files.exists(self.path(name) + "/_SUCCESS")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def write(self, name: str, df: DataFrame) -> DataFrame:
        writers.write_parquet(df, self.path(name))
        return self.read(name)

    def config(self) -> dict:
        return {"rounds": self.rounds, "bins": self.bins, "top_k": self.top_k, "folds": self.folds}

    @cached_property
    def features(self) -> list[str]:
        return list(adapters.FEATURES) if self.given is None else frames.features_of(self.spark, self.given)

    def texts(self) -> DataFrame:
        return adapters.texts(self.spark, self.tables) if self.given is None else frames.texts(self.spark, self.given)

    def frame(self) -> DataFrame:
        return adapters.frame(self.spark, self.tables) if self.given is None else frames.frame(self.spark, self.given)

    def flags(self) -> DataFrame:
        """(feature, kind, source, direct, correlated, duplicate, one_source) of the features."""
        if self.given is not None:
            return frames.read_features(self.spark, self.given)
        f = F.col("feature")
        names = self.spark.createDataFrame([(x,) for x in self.features], "feature string")
        return names.select(f, S.column_part(f, 0).alias("kind"), S.column_part(f, 1).alias("source"), f.endswith("n_lines").alias("direct"), (f.endswith("sum_qty") | f.endswith("total_errors")).alias("correlated"), F.lit(False).alias("duplicate"), f.contains("__price__").alias("one_source"))

    def dictionary(self) -> dict[str, list]:
        """The flags as what is kept beside the prepared data: a dictionary or list that changed later is noticed."""
        return {r["feature"]: list(r)[1:] for r in self.flags().orderBy("feature").collect()}  # a row for each feature


def dataframe(run: Run, metadata_only: bool = False, csv: bool = False, csv_only: bool = False, overwrite: bool = False) -> DataFrame:
    """The wide frame of all texts and sources, or only the texts' labels, as Parquet, CSV or both."""
    name = "metadata" if metadata_only else "frame"
    if run.has(name) and not overwrite:
        raise FileExistsError(f"{run.path(name)}: give --overwrite")
    df = run.texts() if metadata_only else run.frame()
    if csv or csv_only:
        writers.write_csv(df, run.path(f"{name}-csv"))
    return df if csv_only else run.write(name, df)


def prepare(run: Run) -> DataFrame:
    """The frame with the learners' split and its manifest; done once for a run, and compared with the manifest, split
    included, once for a command. A learner in several splits, a missing split or one with a label of under two texts stops
    the run before anything is trained."""
    if not run.has("data"):
        rows = resample.with_split(run.frame())
        problems = {r["problem"]: r["n"] for r in resample.split_problems(rows).where("n > 0").collect()}
        if problems:
            raise ValueError(f"the split can't be used: {problems}")
        run.write("data", rows)
        writers.write_json({"config": run.config(), "dictionary": run.dictionary()}, run.path("prepared.json"))
        writers.write_manifest({"data": run.read("data")}, run.path("manifest.json"))
    elif not run.verified:
        if writers.verify_manifest({"data": run.read("data")}, run.path("manifest.json")):
            raise ValueError("the prepared data changed; use another folder")
        if experiments.recorded(run.path("prepared.json")).get("dictionary", run.dictionary()) != run.dictionary():
            raise ValueError("the dictionary or a list changed; use another folder")
    run.verified = True
    return run.read("data")


def _long(run: Run, rows: DataFrame) -> DataFrame:
    return relational.long_form(rows, run.features, ["text_id", "learner_id", "cefr_level", "level"])


def score(run: Run, method: str, restart: bool = False, relabel: bool = False, listed: DataFrame | None = None) -> DataFrame:
    """Mutual information (mi) or information gain (ig) of every feature over the training texts, with flags and ranks. What is
    stored is used again unless ``restart``; ``relabel`` makes flags and ranks anew from the stored scores."""
    name, need = f"scores-{method}", {"feature": "string", "source": "string", "score": "double"}
    if relabel and not run.has(name):
        raise FileNotFoundError(f"no stored scores in {run.path(name)}")
    if run.has(name) and not restart and not relabel:
        return readers.read_scores(run.spark, run.path(name), need)
    length = F.col("source") == "basic" if run.given is None else F.col("direct") | F.col("correlated")
    listed = listed or run.flags().where(length).select("source", "feature")
    if relabel:
        stored = readers.read_scores(run.spark, run.path(name), need).collect()  # a row for each feature, replaced in place
        scores = run.spark.createDataFrame([(r["feature"], r["source"], r["score"]) for r in stored], "feature string, source string, score double")
    else:
        long = _long(run, prepare(run).where("split = 'train'"))
        found = information.binned_information(long).select("feature", F.col("mi").alias("score")) if method == "mi" else information.information_gain(long).select("feature", F.col("gain").alias("score"))
        scores = found.select("feature", S.column_part(F.col("feature"), 1).alias("source"), "score")
    return run.write(name, context.relabel(scores, listed))


def rank(run: Run, restart: bool = False) -> DataFrame:
    """Both rankings beside each other, of training texts only, with what the top_k of each select."""
    mi = score(run, "mi", restart).select("feature", F.col("score").alias("mi"))
    ig = score(run, "ig", restart).select("feature", F.col("score").alias("gain"))
    out = run.write("ranking", information.ranking(mi, ig, run.top_k))
    writers.write_xlsx(out, run.path("ranking.xlsx"))
    return out


def sets_of(run: Run, use_ranked: bool = True) -> dict[str, list[str]]:
    """The features of each experiment."""
    f, flags = F.col("feature"), run.flags()
    if use_ranked and run.has("ranking"):
        chosen = run.read("ranking").select(f, F.col("selected").isin("Both", "MI only").alias("mi"), F.col("selected").isin("Both", "IG only").alias("ig"))
        flags = flags.join(F.broadcast(chosen), "feature", "left").fillna(False, ["mi", "ig"])  # a row for each feature
    else:
        flags = flags.withColumns({"mi": F.lit(False), "ig": F.lit(False)})
    out: dict[str, list[str]] = {}
    for r in relational.feature_sets(flags).orderBy("name", "feature").collect():
        out.setdefault(r["name"], []).append(r["feature"])
    return out


def train(run: Run, tasks: list[str] = ("level", "cefr"), only: list[str] | None = None) -> None:
    """Models of every experiment, or of those of ``only``, and baselines: a table for each task and algorithm with a folder
    for each model. A finished model of the same settings and features stays, whatever else is trained later."""
    rows = prepare(run).where("split = 'train'")
    sets = {k: v for k, v in sets_of(run).items() if not only or k in only}
    if only and set(only) - set(sets):
        raise ValueError(f"no such experiments: {sorted(set(only) - set(sets))}")
    for task in tasks:
        label, algorithms = TASKS[task]
        for algorithm in algorithms:
            name = f"terms-{task}-{algorithm}"
            done = experiments.recorded(run.path(name + ".json"))
            kept = done.get("sets", {}) if run.has(name) and done.get("config") == run.config() else {}
            new = {k: v for k, v in sets.items() if kept.get(k) != v}
            if not new:
                continue
            terms = experiments.fit_all(rows, new, label, algorithm, run.rounds, run.bins).withColumn("set", F.col("model"))
            mode = "dynamic" if kept else "static"  # other settings: no model of before stays
            terms.write.mode("overwrite").option("partitionOverwriteMode", mode).option("compression", "zstd").partitionBy("set").parquet(run.path(name))
            writers.write_json({"config": run.config(), "sets": {**kept, **new}}, run.path(name + ".json"))


def predictions(run: Run, task: str, algorithm: str, rows: DataFrame, terms: DataFrame) -> DataFrame:
    """(text_id, model, predicted) of rows, the baseline included."""
    p = additive.predict(rows, run.features, terms.where("model <> 'baseline'"))
    if algorithm == "regressor":
        out = p.select("text_id", "model", S.clamp(F.col("score"), 1.0, float(S.LEVELS)).alias("predicted"))
        base = terms.where("model = 'baseline'").select("model", F.col("score").alias("predicted"))
    else:
        out = p.groupBy("text_id", "model").agg(F.max_by("output", F.struct("probability", "output")).alias("predicted"))
        base = terms.where("model = 'baseline' and score = 1").select("model", F.col("output").alias("predicted"))
    one = base.first()  # the baseline is one row
    return out if one is None else out.unionByName(rows.select("text_id", F.lit(one["model"]).alias("model"), F.lit(one["predicted"]).alias("predicted")))


def predicted_of(run: Run, rows: DataFrame, terms_of) -> dict[tuple[str, str], DataFrame]:
    """(model, text_id, learner_id, actual, predicted) of rows for each task and algorithm with terms. terms_of: terms of a
    task and algorithm, or None."""
    out = {}
    for task, (label, algorithms) in TASKS.items():
        for algorithm in algorithms:
            terms = terms_of(task, algorithm)
            if terms is not None:
                kind = "int" if algorithm == "regressor" else "string"
                p = predictions(run, task, algorithm, rows, terms).join(rows.select("text_id", "learner_id", F.col(label).cast(kind).alias("actual")), "text_id")
                out[task, algorithm] = p.withColumn("predicted", F.col("predicted").cast("double" if kind == "int" else "string"))
    if not out:
        raise FileNotFoundError("no trained models; run train first")
    return out


def scores_of(run: Run, rows: DataFrame, terms_of) -> DataFrame:
    """(task, algorithm, model, metric, value) of all models on rows."""
    every = None
    for (task, algorithm), p in predicted_of(run, rows, terms_of).items():
        if algorithm == "regressor":
            found = metrics.regression_scores(p, "actual", "predicted", ["model"])
        else:
            labels = [str(x) for x in LABELS[task]]
            found = metrics.overall_scores(metrics.confusion(p, "actual", "predicted", labels, ["model"]), len(labels), ["model"])
        names = [c for c in found.columns if c not in ("model", "n")]
        found = found.select("model", *[F.col(c).cast("double").alias(c) for c in names]).unpivot(["model"], names, "metric", "value")
        if algorithm == "regressor":
            once = bootstrap.Given(lambda ids, draws: np.ones((len(ids), len(draws)), dtype=int), 1)
            found = found.unionByName(bootstrap.rank_draws(p, bootstrap.blocks_of(p)[0], once, "actual", "predicted").select("model", "metric", "value"))
        found = found.select(F.lit(task).alias("task"), F.lit(algorithm).alias("algorithm"), "model", "metric", "value")
        every = found if every is None else every.unionByName(found)
    return every


def draws_of(run: Run, rows: DataFrame, terms_of) -> DataFrame:
    """(task, algorithm, model, draw, metric, value) of all models in ``draws`` draws of the learners, the same for all."""
    every = None
    for (task, algorithm), p in predicted_of(run, rows, terms_of).items():
        labels = None if algorithm == "regressor" else [str(x) for x in LABELS[task]]
        found = bootstrap.run_draws(p, algorithm, "actual", "predicted", labels, run.draws)
        found = found.select(F.lit(task).alias("task"), F.lit(algorithm).alias("algorithm"), "model", "draw", "metric", "value")
        every = found if every is None else every.unionByName(found)
    return every


#: By which metric models are told apart, and whether more is better.
MAIN = {"classifier": ("macro_f1", True), "regressor": ("mae", False)}


def uncertainty(run: Run, rows: DataFrame, scores: DataFrame, terms_of, name: str) -> DataFrame:
    """scores with sd, low and high (95 %) of each metric over the draws. The tables ``name``-draws and ``name``-differences
    hold the draws, and of each task and algorithm's best model against every other the mean difference, its interval and
    whether that leaves out 0."""
    draws = run.write(f"{name}-draws", draws_of(run, rows, terms_of))
    keys = ["task", "algorithm", "model", "metric"]
    out = scores.join(resample.interval(draws, "value", keys), keys, "left")
    every = None
    for task, algorithm in {(r["task"], r["algorithm"]) for r in scores.select("task", "algorithm").distinct().collect()}:
        metric, more = MAIN[algorithm]
        own = scores.where((F.col("task") == task) & (F.col("algorithm") == algorithm) & (F.col("metric") == metric))
        best = own.orderBy(F.col("value").desc_nulls_last() if more else F.col("value").asc_nulls_last(), "model").first()["model"]
        drawn = draws.where((F.col("task") == task) & (F.col("algorithm") == algorithm) & (F.col("metric") == metric)).select("draw", "model", "value")
        found = resample.paired_difference(drawn, best).select(F.lit(task).alias("task"), F.lit(algorithm).alias("algorithm"), F.lit(metric).alias("metric"), F.lit(best).alias("best"), F.col("model").alias("other"), "mean", "low", "high", "distinguishable")
        every = found if every is None else every.unionByName(found)
    run.write(f"{name}-differences", every)
    return out


def _terms(run: Run):
    return lambda task, algorithm: run.read(f"terms-{task}-{algorithm}").drop("set") if run.has(f"terms-{task}-{algorithm}") else None


def report(run: Run) -> DataFrame:
    """Scores of all models on the validation texts with their bootstrap deviations and intervals, the best models' paired
    differences from the others, scores by label, and the largest contributions of each output's features."""
    rows = prepare(run).where("split = 'validation'")
    out = run.write("report", uncertainty(run, rows, scores_of(run, rows, _terms(run)), _terms(run), "report"))
    every = None
    for (task, algorithm), p in predicted_of(run, rows, _terms(run)).items():
        if algorithm == "classifier":
            found = metrics.class_scores(metrics.confusion(p, "actual", "predicted", [str(x) for x in LABELS[task]], ["model"]), ["model"])
            found = found.select(F.lit(task).alias("task"), "*")
            every = found if every is None else every.unionByName(found)
    if every is not None:
        run.write("report-labels", every)
    for task in TASKS:
        terms = _terms(run)(task, "classifier")
        if terms is not None:
            parts = additive.contributions(rows, run.features, terms.where("model = 'combined'"))
            writers.write_by_output(metrics.contributions(parts), run.path(f"contributions-{task}"))
    return out


def summarize(run: Run) -> DataFrame:
    """The leaderboard of the classifiers, as a table, CSV, Markdown and LaTeX."""
    wide = run.read("report").where("algorithm = 'classifier'").groupBy("task", "model").pivot("metric", ["accuracy", "macro_f1", "ordinal_mae"]).agg(F.first("value"))
    board = metrics.leaderboard(wide.withColumnRenamed("task", "target").withColumn("split", F.lit("validation"))).orderBy("target", "rank")
    out = run.write("leaderboard", board)
    writers.write_report_csv(out.orderBy("target", "rank"), run.path("leaderboard.csv"))
    files.put(run.path("leaderboard.md"), writers.markdown(out.orderBy("target", "rank")).encode())
    files.put(run.path("leaderboard.tex"), writers.latex(out.orderBy("target", "rank")).encode())
    return out


def final_test(run: Run) -> DataFrame:
    """Scores on the test texts, once: the models are sealed before a test label is read, and must be the sealed ones."""
    sealed = {f"{t}-{a}": _terms(run)(t, a) for t, (_, algorithms) in TASKS.items() for a in algorithms}
    sealed = {k: v for k, v in sealed.items() if v is not None}
    if not files.exists(run.path("seal.json")):
        experiments.seal(sealed, run.path("seal.json"))
    experiments.check_seal(sealed, run.path("seal.json"))
    return run.read("final") if run.has("final") else _final(run)


def _final(run: Run) -> DataFrame:
    rows = prepare(run).where("split = 'test'")
    return run.write("final", uncertainty(run, rows, scores_of(run, rows, _terms(run)), _terms(run), "final"))


def whole(run: Run) -> DataFrame:
    """Prepare, rank, train, report and summarize; a sealed run only reports again."""
    prepare(run)
    if not files.exists(run.path("seal.json")):
        rank(run)
        train(run)
    report(run)
    return summarize(run)


def cv_prepare(run: Run, tasks: list[str] = ("level", "cefr"), families: list[str] = ("combined", "length_only")) -> DataFrame:
    """Learner-wise folds of all texts but the test's, the table of jobs, and both rankings inside each fold, all folds at once.
    families: sets of features by name; the sets of a ranking take what is best in the fold's own training texts."""
    if not run.has("folds"):
        run.write("folds", resample.grouped_folds(prepare(run).where("split <> 'test'"), run.folds))
    if not run.has("fold-rankings"):
        rows = prepare(run).where("split <> 'test'").join(run.read("folds"), "learner_id")
        long = relational.long_form(rows, run.features, ["text_id", "level", "fold"])
        run.write("fold-rankings", foldranks.rankings(long, "level", run.folds, run.top_k))
    if not run.has("jobs"):
        made = None
        for task in tasks:
            one = experiments.jobs(run.spark, [task], TASKS[task][1], list(families), run.folds).where("kind <> 'ranking'")
            made = one if made is None else made.unionByName(one)
        run.write("jobs", experiments.job_order(made))
    return run.read("jobs")


def fold_sets(run: Run, fold: int) -> dict[str, list[str]]:
    """The features of each family in a fold: those of the rules, and the best of each ranking inside the fold."""
    best = run.read("fold-rankings").where(F.col("fold") == fold).orderBy("feature").collect()  # a row for each feature
    ranked = {name: [r["feature"] for r in best if r[flag]] for name, flag in RANKED.items()}
    return {**sets_of(run, False), **ranked, "": []}


#: Families of a ranking and what chooses their features.
RANKED = {"training_mutual_information_features": "mi_selected", "training_information_gain_features": "ig_selected"}


def _job_rows(run: Run, fold: int) -> tuple[DataFrame, DataFrame]:
    rows = prepare(run).where("split <> 'test'").join(run.read("folds"), "learner_id")
    return rows.where(F.col("fold") != fold), rows.where(F.col("fold") == fold)


def _cv_job(run: Run, j: Row, features: list[str]) -> None:
    train_rows, held = _job_rows(run, j["fold"])
    algorithm = {"majority": "classifier", "median": "regressor"}.get(j["algorithm"], j["algorithm"])
    label = TASKS[j["task"]][0]
    terms = additive.dummy(train_rows, label, algorithm) if j["kind"] == "baseline" else experiments.fit_all(train_rows, {j["family"]: features}, label, algorithm, run.rounds, run.bins).where("model <> 'baseline'")
    only = lambda t, a: terms if (t, a) == (j["task"], algorithm) else None
    run.write(f"results/job_id={j['job_id']}", scores_of(run, held, only).withColumns({"fold": F.lit(j["fold"]), "kind": F.lit(j["kind"])}))


def cv_run(run: Run, job: str | None = None, parallel: int = 4) -> None:
    """Fits and scores the jobs that have no result yet, or one of them, up to ``parallel`` at once so that a job's few tasks
    leave no executor idle; a job's result is a folder, so a stopped run goes on with those that are missing."""
    left = [j for j in cv_prepare(run).orderBy("place").collect() if job in (None, j["job_id"]) and not run.has(f"results/job_id={j['job_id']}")]
    sets = {k: fold_sets(run, k) for k in {j["fold"] for j in left}}
    empty = sorted({j["family"] for j in left if j["kind"] == "fit" and not sets[j["fold"]].get(j["family"])})
    if empty:
        raise ValueError(f"no features in {empty}")
    with ThreadPoolExecutor(parallel) as pool:
        for done in [pool.submit(_cv_job, run, j, sets[j["fold"]][j["family"]]) for j in left]:
            done.result()


def cv_status(run: Run) -> DataFrame:
    """(kind, jobs, done) of the jobs."""
    jobs = cv_prepare(run)
    done = [j["job_id"] for j in jobs.select("job_id").collect() if run.has(f"results/job_id={j['job_id']}")]
    return jobs.groupBy("kind").agg(F.count("*").alias("jobs"), F.count_if(F.col("job_id").isin(done)).alias("done"))


def cv_summarize(run: Run) -> DataFrame:
    """Mean and deviation over the folds, of models of which all folds are there."""
    scores = run.spark.read.parquet(run.path("results")).drop("job_id")
    return run.write("cv-summary", metrics.fold_summary(scores, ["task", "algorithm", "model"], run.folds))


def validity(run: Run, check: str) -> DataFrame:
    """topic: seen against unseen tasks of half the tasks; tasks: leaving one task of each level out; length: features that
    follow the length within levels."""
    rows = prepare(run)
    if check == "length":
        if run.given is not None and run.given.words is None:
            raise ValueError("say which feature counts words")
        words = rows.select("text_id", F.col(S.quoted("complexity__basic__sum_qty" if run.given is None else run.given.words)).alias("words"))
        return run.write("validity-length", correlate.length_dependence(_long(run, rows), words))
    if "topic" not in rows.columns:
        raise ValueError("the texts have no topic")
    if check == "topic":
        return run.write("validity-topic", experiments.transfer(rows, run.features, run.rounds, run.bins))
    folds = resample.task_folds(rows)
    every = None
    for k in range(1, 9):
        held = rows.join(F.broadcast(folds.where(F.col("fold") == k)), ["level", "topic"], "left_semi").where("split = 'validation'")
        train_rows = rows.join(F.broadcast(folds.where(F.col("fold") == k)), ["level", "topic"], "left_anti").where("split = 'train'").withColumn("model", F.lit("combined"))
        p = additive.predict(held, run.features, additive.fit(train_rows, run.features, "level", "regressor", run.rounds, run.bins))
        one = metrics.regression_scores(held.join(p.select("text_id", S.clamp(F.col("score"), 1.0, float(S.LEVELS)).alias("p")), "text_id"), "level", "p").withColumn("fold", F.lit(k))
        every = one if every is None else every.unionByName(one)
    return run.write("validity-tasks", every)


def tables(run: Run) -> None:
    """The written summaries of features and correlations and, of the bundled tables, which have edits, of errors."""
    rows = prepare(run)
    long = _long(run, rows)
    reports.write_lines(reports.feature_summary(describe.feature_statistics(long), describe.feature_statistics(long, "cefr_level", "level")), run.path("features.txt"))
    tests = correlate.correlations(long).withColumn("strength", S.strength(F.col("spearman")))
    tests = correlate.benjamini_hochberg(tests.withColumn("p", correlate.p_value(F.col("spearman"), F.col("n"))))
    reports.write_lines(reports.correlation_summary(tests), run.path("correlations.txt"))
    if run.given is not None:
        return
    r = rows.select("cefr_level", "level", F.col("accuracy__edits__total_errors").alias("errors"), F.col("complexity__basic__sum_qty").alias("words"), F.col("accuracy__edits__open_errors").alias("open")).where("words is not null")
    types = describe.error_types(adapters.edits(run.spark, run.tables), adapters.texts(run.spark, run.tables))
    reports.write_lines(reports.error_summary(describe.error_statistics(r, "errors", "words", "open"), types), run.path("errors.txt"))
