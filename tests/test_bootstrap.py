"""The bootstrap by vectors over draws: weighted metrics are those of physically repeated rows."""

import math

import numpy as np
import pandas as pd
import pytest

from textloom.operators import bootstrap, resample

SCHEMA = "model string, learner_id long, level int, p int, x double"


def rows_of(n, seed=0):
    rng = np.random.default_rng(seed)
    out = []
    for model in "ab":
        for i in range(n):
            level = int(rng.integers(1, 6))
            x = 5.0 if i < 5 else float(np.clip(level + rng.normal(), 1, 5))  # ties
            out.append((model, i // 3, level, int(round(x)), x))
    return out


def metrics_of(rows):
    t = pd.DataFrame(rows, columns=["model", "learner", "y", "p", "x"])
    matrix = np.zeros((1, 5, 5))
    np.add.at(matrix[0], (t.y - 1, t.p - 1), 1)
    n, f = len(t), []
    for k in range(1, 6):
        hit, size = ((t.y == k) & (t.p == k)).sum(), (t.y == k).sum() + (t.p == k).sum()
        f.append(2 * hit / size if size else 0)
    gap = (t.y - t.p).abs()
    chance = sum((t.y == a).sum() * (t.p == b).sum() * (a - b) ** 2 for a in range(1, 6) for b in range(1, 6)) / n
    out = {"accuracy": (gap == 0).mean(), "macro_f1": np.mean(f), "ordinal_mae": gap.mean(), "within_one": (gap <= 1).mean(), "qwk": 1 - (gap**2).sum() / chance if chance else None}
    d = t.x - t.y
    out |= {"mae": d.abs().mean(), "rmse": math.sqrt((d * d).mean()), "r2": 1 - (d * d).sum() / ((t.y - t.y.mean()) ** 2).sum() if t.y.nunique() > 1 else None}
    return out | {"spearman": t.x.rank().corr(t.y.rank()) if t.y.nunique() > 1 and t.x.nunique() > 1 else None}


@pytest.mark.parametrize("n,block", [(90, 1024), (400, 7)])
def test_weighted_metrics_are_those_of_repeated_rows(spark, monkeypatch, n, block):
    monkeypatch.setattr(bootstrap, "BLOCK", block)
    monkeypatch.setattr(bootstrap, "MEMBERS", 5)
    monkeypatch.setattr(bootstrap, "HELD", 4096)
    rows = rows_of(n)
    df = spark.createDataFrame(rows + [("a", None, 1, 1, 1.0)], SCHEMA).repartition(6)
    weights = {(r["draw"], r["learner_id"]): r["weight"] for r in resample.bootstrap_weights(df, 6).collect()}
    assert {d: sum(v for (k, _), v in weights.items() if k == d) for d in range(6)} == dict.fromkeys(range(6), len({r[1] for r in rows}))
    got = {}
    for kind, p in (("classifier", "p"), ("regressor", "x")):
        for r in bootstrap.run_draws(df, kind, "level", p, [1, 2, 3, 4, 5], draws=6).collect():
            got[r["model"], r["draw"], r["metric"]] = r["value"]
    assert len(got) == 2 * 6 * 9
    for model in "ab":
        for d in range(6):
            want = metrics_of([r for r in rows if r[0] == model for _ in range(weights.get((d, r[1]), 0))])
            for k, v in want.items():
                assert math.isclose(got[model, d, k], v, abs_tol=1e-9), k


def test_draws_are_multinomial():
    sizes = np.array([3, 0, 700, 41])
    rule = bootstrap.Multinomial(sizes, 400, 7)
    w = np.concatenate([np.concatenate([x for _, x in rule.of(b, None)]) if s else np.zeros((0, 400), int) for b, s in enumerate(sizes)])
    assert w.shape == (744, 400) and (w.sum(axis=0) == 744).all()
    assert abs(w.var() - (1 - 1 / 744)) < 0.02 and abs(np.corrcoef(w[0], w[5])[0, 1]) < 0.2


def test_undefined_metrics_are_null(spark):
    df = spark.createDataFrame([("a", i, 2, 2, 2.0) for i in range(9)], SCHEMA)
    one = {r["metric"]: r["value"] for r in bootstrap.run_draws(df, "classifier", "level", "p", [1, 2], draws=1).collect()}
    assert one == {"accuracy": 1.0, "macro_f1": 0.5, "ordinal_mae": 0.0, "within_one": 1.0, "qwk": None}
    other = {r["metric"]: r["value"] for r in bootstrap.run_draws(df, "regressor", "level", "x", draws=1).collect()}
    assert other == {"mae": 0.0, "rmse": 0.0, "r2": None, "spearman": None}
