"""Command line: the registered queries, and the steps of an analysis over a folder of tables into a run's folder."""

from __future__ import annotations

import argparse
import dataclasses
import sys

from textloom import workflow
from textloom.operators.relational import FEATURE_SETS
from textloom.plans import files, pipelines, relational, statistics  # noqa: F401  (they register their queries)
from textloom.plans.registry import QUERIES
from textloom.session import session
from textloom.sources import frames


#: The tables and names of a frame of any columns.
GIVEN = [f.name for f in dataclasses.fields(frames.Given)]


def _given(a: argparse.Namespace) -> frames.Given | None:
    """The frame that the arguments give, None for the bundled tables'."""
    said = {name: getattr(a, name) for name in GIVEN if getattr(a, name) is not None}
    if not said:
        return None
    if missing := {"frame", "dictionary", "learners"} - said.keys():
        raise ValueError(f"a frame of any columns needs {sorted(missing)} too")
    return frames.Given(**{k: v if k in ("one_source", "words") or "/" in v else f"{a.tables.rstrip('/')}/{v}" for k, v in said.items()})


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="python -m textloom", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)
    commands.add_parser("list", help="the registered queries")
    for name, text in (("query", "run a query into Parquet"), ("explain", "show a query's plan")):
        p = commands.add_parser(name, help=text)
        p.add_argument("name", choices=sorted(QUERIES), metavar="NAME")
        p.add_argument("tables")
        if name == "query":
            p.add_argument("out")

    def step(name: str, text: str, *steps: str) -> argparse.ArgumentParser:
        p = commands.add_parser(name, help=text)
        if steps:
            p.add_argument("step", choices=steps)
        p.add_argument("tables")
        p.add_argument("out")
        p.add_argument("--rounds", type=int, default=200)
        p.add_argument("--bins", type=int, default=128)
        p.add_argument("--top-k", type=int, default=200)
        p.add_argument("--folds", type=int, default=10)
        p.add_argument("--draws", type=int, default=2000)
        for table in GIVEN:
            p.add_argument(f"--{table.replace('_', '-')}", help="of a frame of any columns; a table by its name in the folder or its path")
        return p

    p = step("dataframe", "build the wide frame")
    for flag in ("metadata-only", "csv", "csv-only", "overwrite"):
        p.add_argument(f"--{flag}", action="store_true")
    for method in ("mi", "ig"):
        p = step(method, "score all features")
        p.add_argument("--restart", action="store_true")
        p.add_argument("--relabel", action="store_true")
    p = step("workflow", "a step of an analysis", "run", "prepare", "rank", "train", "report", "summarize", "final-test")
    p.add_argument("--task", choices=sorted(workflow.TASKS), action="append")
    p.add_argument("--experiments", nargs="+")
    step("pipeline", "all steps of an analysis")
    p = step("cv", "cross-validation", "prepare", "run", "status", "summarize")
    p.add_argument("--job")
    p.add_argument("--families", nargs="+", choices=sorted(FEATURE_SETS), default=["combined", "length_only"])
    step("validity", "validity checks", "topic", "length", "tasks")
    step("tables", "written summaries")
    return top


def main(args: list[str]) -> int:
    a = _parser().parse_args(args)
    if a.command == "list":
        print("\n".join(QUERIES))
        return 0
    spark = session()
    if a.command == "query":
        QUERIES[a.name](spark, a.tables).write.mode("overwrite").parquet(a.out)
        return 0
    if a.command == "explain":
        QUERIES[a.name](spark, a.tables).explain("formatted")
        return 0
    run = workflow.Run(spark, a.tables, a.out, a.rounds, a.bins, a.top_k, a.folds, a.draws, _given(a))
    match a.command, getattr(a, "step", None):
        case "dataframe", _:
            workflow.dataframe(run, a.metadata_only, a.csv, a.csv_only, a.overwrite)
        case ("mi" | "ig") as method, _:
            workflow.score(run, method, a.restart, a.relabel)
        case "workflow", "prepare":
            workflow.prepare(run)
        case "workflow", "rank":
            workflow.rank(run)
        case "workflow", "train":
            workflow.train(run, a.task or list(workflow.TASKS), a.experiments)
        case "workflow", "report":
            workflow.report(run)
        case "workflow", "summarize":
            workflow.summarize(run)
        case "workflow", "final-test":
            workflow.final_test(run)
        case ("workflow", "run") | ("pipeline", _):
            workflow.whole(run)
        case "cv", "prepare":
            workflow.cv_prepare(run, families=a.families)
        case "cv", "run":
            workflow.cv_run(run, a.job)
        case "cv", "status":
            workflow.cv_status(run).show(truncate=False)
        case "cv", "summarize":
            workflow.cv_summarize(run)
        case "validity", check:
            workflow.validity(run, check)
        case "tables", _:
            workflow.tables(run)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
