"""Edits and distinct texts of patterns, for any number of edits."""

from collections import Counter, defaultdict

import pytest

from textloom.operators import describe


@pytest.mark.parametrize("task", [7, 500_000])
def test_patterns_of_repeated_texts(spark, monkeypatch, task):
    monkeypatch.setattr(describe, "TASK_EDITS", task, raising=False)
    texts = [(i % 40 if i % 9 else None, "AB"[i % 2] if i % 7 else None, i % 3) for i in range(60)]
    texts += texts[:15]
    edits = [(i % 50 if i % 11 else None, "xyz"[i % 3], i % 4 if i % 13 else None) for i in range(300)]
    got = describe.patterns(spark.createDataFrame(edits, "text_id long, kind string, width long"), spark.createDataFrame(texts, "text_id long, band string, level long"), ["kind", "width"], ["band", "level"], ["band", "kind"])
    n, seen, whole = Counter(), defaultdict(set), Counter()
    for t, kind, width in edits:
        for u, band, level in texts:
            if t is not None and t == u:
                n[band, level, kind, width] += 1
                seen[band, level, kind, width].add(t)
                whole[band, kind] += 1
    want = {(*k, v, len(seen[k]), v / whole[k[0], k[2]]) for k, v in n.items()}
    rows = {tuple(r[c] for c in ("band", "level", "kind", "width", "n", "texts", "share")) for r in got.collect()}
    assert rows == want
    if task == 7:  # tasks follow the edits, not the session's number of partitions
        assert "hashpartitioning(text_id#" in (plan := got._jdf.queryExecution().executedPlan().toString()) and ", 43)" in plan
