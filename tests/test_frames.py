"""Runs over frames of any columns: features, flags, learners and levels are tables, and what does not agree raises."""

import csv
import gzip

import numpy as np
import pandas as pd
import pytest

from textloom import __main__ as command
from textloom import workflow
from textloom.operators import relational
from textloom.sources import frames

BANDS = ["A1", "A2", "B1", "B2", "C1"]
ERRORS = {"total": lambda i: 10 + i % 4, "missing": lambda i: i % 3, "unnecessary": lambda i: i % 2, "replacement": lambda i: 5 + i % 2, "other": lambda i: i % 2}


def write_csv(path, rows, opened=open):
    with opened(path, "wt", newline="", encoding="utf-8") as f:
        csv.writer(f).writerows(rows)


def fixture(folder, extra=(), n=1800):
    """The tables of n texts of 15 levels, two of each learner; extra: further columns, by name."""
    ids = np.arange(1, n + 1)
    level = (ids - 1) % 15 + 1
    columns = {"complexity__LCA__ld": level + ids / 100000, "complexity__SCA__C/S": level * 2.0 + ids % 5 / 10, "complexity__own__a.b c": np.where(ids % 7 == 0, np.inf, ids % 11)}
    columns |= {f"accuracy__edits__{k}_errors": [f(i) for i in ids] for k, f in ERRORS.items()} | {"accuracy__edits__errors_per_100_words": (10 + ids % 4) / level} | dict(extra)
    band = [BANDS[(v - 1) // 3] for v in level]
    pd.DataFrame({"text_id": ids, "cefr_level": band, **columns}).to_parquet(f"{folder}/frame.parquet", index=False)
    pd.DataFrame({"text_id": ids, "cefr_level": band, "level": level.astype(np.int32)}).to_parquet(f"{folder}/labels.parquet", index=False)
    write_csv(f"{folder}/learners.csv.gz", [("writing_id", "cefr", "learner_id"), *[(f"{i}.0", f" {b.lower()}", (i - 1) // 2) for i, b in zip(ids, band, strict=True)]], gzip.open)
    write_csv(f"{folder}/dictionary.csv", [("column", "group", "source", "original_feature", "measure_type"), *[(c, *c.split("__"), "x") for c in reversed(columns)]])
    write_csv(f"{folder}/direct.csv", [("column",), ("accuracy__edits__total_errors",)])
    write_csv(f"{folder}/correlated.csv", [("column",), *[(f"accuracy__edits__{k}_errors",) for k in ERRORS if k != "total"]])
    write_csv(f"{folder}/duplicate.csv", [("column",), ("accuracy__edits__missing_errors",)])
    return list(columns)


GIVEN = ["--frame", "frame.parquet", "--dictionary", "dictionary.csv", "--learners", "learners.csv", "--labels", "labels.parquet", "--direct", "direct.csv", "--correlated", "correlated.csv", "--duplicate", "duplicate.csv", "--one-source", "SCA", "--words", "accuracy__edits__total_errors"]


def given(folder, **other):
    return frames.Given(**{**{k[2:].replace("-", "_"): v if k in ("--one-source", "--words") else f"{folder}/{v}" for k, v in zip(GIVEN[::2], GIVEN[1::2], strict=True)}, **other})


def test_commands_run_on_a_given_frame(spark, tmp_path):
    names = fixture(tmp_path)
    folder, out = str(tmp_path), f"{tmp_path}/run"
    few = ["--rounds", "4", "--bins", "8", "--top-k", "2", "--folds", "2", "--draws", "5", *GIVEN]
    command.main(["dataframe", folder, out, *few])
    run = workflow.Run(spark, folder, out, 4, 8, 2, 2, 20, given(folder))
    frame = run.read("frame")
    assert frame.columns == ["text_id", "learner_id", "cefr_level", "level", *names] and frame.count() == 1800
    assert frame.where("`complexity__own__a.b c` is null").count() == 1800 // 7  # infinite is missing
    command.main(["workflow", "prepare", folder, out, *few])
    command.main(["workflow", "rank", folder, out, *few])
    best = {r["feature"] for r in run.read("ranking").where("ig_rank <= 2").collect()}
    assert best == {"complexity__LCA__ld", "complexity__SCA__C/S"}
    assert {r["feature"] for r in run.read("scores-mi").where("is_length").collect()} == {f"accuracy__edits__{k}_errors" for k in ERRORS}
    sets = workflow.sets_of(run)
    assert sets["length_only"] == ["accuracy__edits__total_errors"] and sets["one_source"] == ["complexity__SCA__C/S"]
    assert set(sets["combined_without_duplicate_features"]) == set(names) - {"accuracy__edits__missing_errors"}
    assert set(sets["combined_without_length_correlated_features"]) == {n for n in names if not n.endswith("errors")}
    command.main(["workflow", "train", folder, out, *few, "--task", "level", "--experiments", "combined"])
    held = run.read("data").where("split = 'validation'")
    regressor = lambda task, algorithm: workflow._terms(run)(task, algorithm) if algorithm == "regressor" else None
    mae = {r["model"]: r["value"] for r in workflow.scores_of(run, held, regressor).where("metric = 'mae'").collect()}
    assert mae["combined"] < mae["baseline"]
    with pytest.raises(ValueError, match="no topic"):
        command.main(["validity", "topic", folder, out, *few])
    write_csv(f"{folder}/duplicate.csv", [("column",), ("accuracy__edits__other_errors",)])
    with pytest.raises(ValueError, match="list changed"):
        workflow.prepare(workflow.Run(spark, folder, out, 4, 8, 2, 2, 20, given(folder)))


def test_a_frame_of_1800_columns(spark, tmp_path):
    """A wide frame becomes long without a projection for each column, and keeps every value."""
    rng = np.random.default_rng(2)
    level = np.arange(240) % 15 + 1
    extra = {f"complexity__s{j % 7}__f{j}": rng.normal(0, 1, 240) + (level if j == 1234 else 0) for j in range(1792)}
    names = fixture(tmp_path, extra, 240)
    folder = str(tmp_path)
    run = workflow.Run(spark, folder, f"{tmp_path}/run", top_k=3, given=given(folder, labels=None, frame=f"{folder}/labelled.parquet"))
    pd.read_parquet(f"{folder}/frame.parquet").assign(level=level).to_parquet(f"{folder}/labelled.parquet")
    assert run.features == names and len(names) == 1801
    long = relational.long_form(run.frame(), run.features, ["text_id", "level"])
    plan = long._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan
    assert long.count() == 240 * 1801
    own = long.where("feature in ('complexity__s2__f1234', 'accuracy__edits__other_errors')")
    assert {(r["text_id"], r["feature"]): r["value"] for r in own.collect()} == {(i + 1, f): float(v) for f, x in (("complexity__s2__f1234", extra["complexity__s2__f1234"]), ("accuracy__edits__other_errors", [i % 2 for i in range(1, 241)])) for i, v in enumerate(x)}


def broken(folder, what):
    frame, labels = pd.read_parquet(f"{folder}/frame.parquet"), pd.read_parquet(f"{folder}/labels.parquet")
    if what == "repeated text":
        frame = pd.concat([frame, frame.head(1)])
    elif what == "null id":
        frame["text_id"] = frame["text_id"].astype("Int64").where(frame["text_id"] != 5)
    elif what == "missing text":
        frame = frame.iloc[1:]
    elif what == "other band":
        frame.loc[3, "cefr_level"] = "C1"
    elif what == "unknown feature":
        frame["complexity__x__y"] = 1.0
    elif what == "level of two bands":
        labels.loc[0, "level"] = 15
    elif what == "no level":
        labels = labels.drop(columns="level")
    frame.to_parquet(f"{folder}/frame.parquet", index=False)
    labels.to_parquet(f"{folder}/labels.parquet", index=False)


@pytest.mark.parametrize("what", ["repeated text", "null id", "missing text", "other band", "unknown feature", "level of two bands", "no level"])
def test_what_does_not_agree_raises(spark, tmp_path, what):
    fixture(tmp_path, n=60)
    broken(tmp_path, what)
    with pytest.raises(ValueError):
        frames.frame(spark, given(str(tmp_path)))


@pytest.mark.parametrize("row", ["complexity,LCA,other", "fluency,LCA,ld", ",,"])
def test_a_wrong_dictionary_raises(spark, tmp_path, row):
    fixture(tmp_path, n=60)
    lines = (tmp_path / "dictionary.csv").read_text().splitlines()
    (tmp_path / "dictionary.csv").write_text("\n".join(f"complexity__LCA__ld,{row},x" if line.startswith("complexity__LCA__ld") else line for line in lines))
    with pytest.raises(ValueError):
        frames.read_features(spark, given(str(tmp_path)))


def test_lists_name_features_of_the_dictionary(spark, tmp_path):
    fixture(tmp_path, n=60)
    write_csv(tmp_path / "direct.csv", [("column",), ("complexity__none__such",)])
    with pytest.raises(ValueError, match="lacks"):
        frames.read_features(spark, given(str(tmp_path)))
    with pytest.raises(ValueError, match="needs"):
        command.main(["dataframe", str(tmp_path), f"{tmp_path}/run", "--frame", "frame.parquet"])
