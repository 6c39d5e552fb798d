"""Operator 12: the merge of transforms against sorted suffixes, and whole results against brute force."""

import hashlib

import numpy as np
import pytest

from textloom.llm import bwt
from textloom.llm import suffix_dedup as s

SCHEMA = "doc_id long, text string, row long, key string, start string"


@pytest.mark.parametrize("length", [1, 2, 3, 8, 12, 20, 100])
def test_merged_transforms_hold_the_order_and_the_common_prefixes_of_all_suffixes(length):
    rng = np.random.default_rng(length)
    for k, letters in ((1, 3), (2, 1), (3, 2), (5, 3), (300, 2)):
        data = [rng.integers(0, letters, int(rng.integers(1, 200 if k < 100 else 5))).astype(np.uint8) for _ in range(k)]
        shards = [bwt.Shard(d, length) for d in data]
        z, common = bwt.merge(shards, length)
        taken, merged = [0] * k, []
        for shard in z:
            at = shards[shard].places[taken[shard]]
            taken[shard] += 1
            merged.append(bytes(np.resize(np.roll(data[shard], -at), length)))
        assert merged == sorted(merged)
        stride = bwt.stride_for(length)
        for a, b, n in zip(merged, merged[1:], common[1:], strict=False):
            assert a[: n * stride] == b[: n * stride] and (n * stride == length or a[: (n + 1) * stride] != b[: (n + 1) * stride])


def brute(rows, length):
    texts = [(d, (t or "").encode()) for d, t, *_ in rows]
    low = {}
    for d, raw in texts:
        if d is not None:
            for i in range(len(raw) - length + 1):
                low[raw[i : i + length]] = min(low.get(raw[i : i + length], d), d)
    out = []
    for d, raw in texts:
        gone, seen = [False] * len(raw), set()
        for i in range(len(raw) - length + 1 if d is not None else 0):
            w = raw[i : i + length]
            if low[w] < d or w in seen:
                gone[i : i + length] = [True] * length
            seen.add(w)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        out.append((d, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest(), kept))
    return out


def check(spark, rows, length, **more):
    got = s.remove_repeats(spark.createDataFrame(rows, SCHEMA).repartition(6), length, bytes_out=True, **more)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    order = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted([(*r[:5], bytes(r[5])) for r in got.collect()], key=order) == sorted(brute(rows, length), key=order)


def rows_of(rng, n):
    words = ["".join(rng.choice(list("abcdeéß日"), int(rng.integers(1, 7)))) for _ in range(60)]
    passages = [" ".join(rng.choice(words, 60)) for _ in range(4)]
    rows = []
    for i in range(n):
        text = " ".join(rng.choice(words, int(rng.integers(1, 80))))
        for p in passages:
            if rng.random() < 0.3:
                cut = sorted(int(x) for x in rng.integers(0, len(p), 2))
                text = text[: len(text) // 2] + p[cut[0] : cut[1]] + text[len(text) // 2 :]
        rows.append((int(rng.integers(0, n)), text, 1, "k", "s"))
    rows += rows[:5] + [(3, "ab" * 300, 1, "", ""), (9, "ab" * 300 + "c" * 150, 1, "", ""), (7, None, 1, "", ""), (8, "", 1, "", ""), (None, "ab" * 300, 1, "", ""), (3, "x" + "ab" * 300, 1, "", "")]
    return rows


@pytest.mark.parametrize("length,more", [(100, {}), (40, {"gram": 40}), (12, {"gram": 3}), (30, {"part": 1, "hot": 2}), (17, {"part": 2, "hot": 1})])
def test_equals_brute_force(spark, length, more):
    check(spark, rows_of(np.random.default_rng(length), 60), length, **more)


def test_long_texts_are_worked_on_part_by_part(spark):
    rng = np.random.default_rng(1)
    long = "".join(rng.choice(list("abcdefgh "), 150_000))
    check(spark, [(1, long[:140_000], 1, "", ""), (2, "q" + long, 1, "", ""), (3, long[70_000:70_300] + "zz" + long[20_000:90_000], 1, "", "")], 100)


def test_a_passage_of_all_documents_with_borders_of_their_own(spark):
    rng = np.random.default_rng(2)
    passage = "".join(rng.choice(list("abcdefgh "), 230))
    rows = [(i, "".join(rng.choice(list("xyz "), 90)) + passage + "".join(rng.choice(list("uvw "), 90)), 1, "", "") for i in range(300)]
    check(spark, rows, 100, part=2, hot=5)


def test_thousands_of_equal_rows_and_empty_tables(spark):
    text = " ".join(str(i * 7919 % 1000) for i in range(300))
    rows = spark.createDataFrame([(5, text, 1, "", ""), (6, text + "!", 1, "", "")], SCHEMA).crossJoin(spark.range(3000).select("id"))
    got = {tuple(r): n for *r, n in s.remove_repeats(rows).groupBy("doc_id", "n_removed", "n_spans").count().collect()}
    assert got == {(5, 0, 0): 3000, (6, len(text), 1): 3000}
    assert s.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0
    with pytest.raises(ValueError):
        s.remove_repeats(rows, 100, gram=101)
