"""Operator 11 against exact sums and numpy's eigenvectors of the covariance."""

import math

import numpy as np
import pytest

from textloom.llm import whitening as w

SCHEMA = "vec_id long, embedding array<float>, label int, n int, dims string, x string"


def table(spark, vectors):
    return spark.createDataFrame([(i, v, 1, 0, "", "") for i, v in vectors], SCHEMA)


def brute(vectors, components):
    rows = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in vectors if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in rows}), dtype=object)
    n, sums = len(fit), fit.sum(axis=0)
    centred = ((n * fit - sums) / n).astype(float)
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = np.maximum(values[::-1], 0), vectors[:, ::-1]
    out = {}
    for i, x in rows:
        d = n * np.array(x, dtype=object) - sums
        for k in range(min(components, len(x))):
            out.setdefault((i, k + 1), []).append((n, int((d * d).sum()), float((d / n).astype(float) @ vectors[:, k]) / math.sqrt(values[k]) if values[k] > 1e-9 else None, values[k] / values.sum()))
    return out


def compare(got, want):
    rows = {}
    for row in got.collect():
        rows.setdefault((row["vec_id"], row["component"]), []).append(row)
        assert row["identity_error"] < 1e-9
    assert rows.keys() == want.keys()
    sign = {}
    for key, all_of in rows.items():
        assert len(all_of) == len(want[key])
        for row, (n, deviation, white, share) in zip(sorted(all_of, key=lambda r: r["deviation"]), sorted(want[key], key=lambda r: r[1]), strict=True):
            assert (row["n"], int(row["deviation"])) == (n, deviation)
            assert math.isclose(row["explained"], share, rel_tol=1e-9, abs_tol=1e-12)
            assert (row["whitened"] is None) == (white is None)
            if white is not None and abs(white) > 1e-6:
                assert math.isclose(abs(row["whitened"]), abs(white), rel_tol=1e-7)
                assert sign.setdefault(key[1], row["whitened"] * white > 0) == (row["whitened"] * white > 0)


def test_whitening_equals_eigenvectors_of_the_covariance(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(700, 9)) * np.array([5, 3, 2, 1, 0.7, 0.5, 0.3, 0.2, 0.1]) @ np.linalg.qr(rng.normal(size=(9, 9)))[0]
    vectors = [(i, [float(c) for c in v]) for i, v in enumerate(base)]
    vectors += [(1000 + i, vectors[0][1]) for i in range(300)] + [(1, vectors[1][1]), (2000, None), (2001, [None] * 9), (2002, [float("nan")] + [0.0] * 8), (2003, [float("inf")] * 9), (2004, [3e30] * 9), (2005, [0.1] * 3), (2006, [])]
    good = [v for v in vectors if not 2004 <= v[0] <= 2006]
    got = w.whiten(table(spark, vectors).repartition(40))
    compare(got, brute(good, 4))
    assert got.schema.simpleString() == spark.createDataFrame([], w.RESULT).schema.simpleString()


def test_many_factors_are_merged_level_by_level(spark, monkeypatch):
    monkeypatch.setattr(w, "FAN", 2)
    rng = np.random.default_rng(6)
    vectors = [(i, [float(c) for c in v]) for i, v in enumerate(rng.normal(size=(200, 3)) * [9, 4, 1])]
    fit = w._quantized(table(spark, vectors).selectExpr("vec_id", "cast(embedding as array<double>) v"), 256).repartition(13)
    x = np.floor(256 * np.float32([v for _, v in vectors]).astype(float)).astype(int)
    model = w.Model(200, x.sum(axis=0).tolist())
    r = w._factor(fit, model)
    centred = x - x.mean(axis=0)
    assert np.allclose(r.T @ r, centred.T @ centred) and r.shape == (3, 3)


@pytest.mark.parametrize("vectors", [[(1, [0.5, -0.25])], [(1, [0.5, 1.0]), (2, [0.5, 1.0]), (None, [0.5, 1.0])]])
def test_no_variance_whitens_nothing(spark, vectors):
    rows = w.whiten(table(spark, vectors)).collect()
    assert len(rows) == 2 * len(vectors)
    assert {(r["n"], int(r["deviation"]), r["whitened"], r["explained"], r["identity_error"]) for r in rows} == {(1, 0, None, 0.0, 0.0)}


def test_fewer_vectors_than_dimensions(spark):
    rows = w.whiten(table(spark, [(1, [0.0] * 5), (2, [1.0] * 5), (3, [2.0, 0.0, 0.0, 0.0, 0.0])])).collect()
    assert len(rows) == 12
    assert all((r["whitened"] is None) == (r["component"] > 2) for r in rows)
    assert math.isclose(sum(r["explained"] for r in rows if r["vec_id"] == 1), 1)


def test_deviations_are_exact_at_every_size():
    for n, x in ((3, [[5, -7]]), (10**7, [[30_000, -20_000]]), (10**9, [[1 << 30, -(1 << 30)]]), (10**6, [[1 << 60, 5]])):
        model = w.Model(n, [n // 3, -n // 7])
        want = sum((n * a - s) ** 2 for a, s in zip(x[0], model.sums, strict=True))
        assert model.deviation(np.array(x)).to_pylist() == [want if want < 10**38 else None]


def test_empty_table(spark):
    assert w.whiten(table(spark, [])).count() == 0
    assert w.whiten(table(spark, [(1, None), (2, [])])).count() == 0
