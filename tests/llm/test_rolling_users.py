"""Operator 13 against brute force on hard tables, and its kernels against plain loops."""

from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pytest

from textloom.llm import rolling_users as r

SCHEMA = "click_id long, ts timestamp_ntz, kind string, client_id long, extra string, minute string"
START = datetime(1970, 1, 1)


def ints(x):
    return [sum(int(limb) << 64 * i for i, limb in enumerate(column)) for column in x.T]


def test_dilation_and_thermometer_are_those_of_whole_numbers():
    rng = np.random.default_rng(3)
    counts = rng.choice([0, 0, 0, 0, 1, 2, 5], size=(640, 3))
    planes = [np.packbits(counts > k, axis=0, bitorder="little") for k in range(3)]
    planes = [np.ascontiguousarray(p.T).view(np.uint64).T.copy() for p in planes]
    for length in (1, 2, 5, 64, 65, 100, 137, 640):
        window = np.stack([np.convolve(c, np.ones(length, dtype=int))[:640] for c in counts.T], axis=1)
        for k, plane in enumerate(r.thermometer(planes, length)):
            assert [bin(x).count("1") for x in ints(plane)] == list((window > k).sum(axis=0))
            assert ints(plane) == [sum(1 << int(m) for m in np.flatnonzero(w > k)) for w in window.T]
        assert ints(r.dilated(planes[0], 1, length)) == ints(r.thermometer(planes, length)[0])
        runs = window > 0
        want = np.diff(np.vstack([np.zeros(3, dtype=int), runs.astype(int)]), axis=0).sum(axis=1)
        assert (r.edges(r.dilated(planes[0], 1, length)) == want).all()


def brute(rows, windows, hot, hot_window):
    one, alone = {}, []
    for click, ts, kind, client, *_ in rows:
        if ts is None or kind is None:
            continue
        c = ((ts - START) // timedelta(minutes=1), kind, (client is not None, client or 0))
        if click is None:
            alone.append(c)
        else:
            one[click] = min(one.get(click, c), c)
    clicks = [(m, k, client) for m, k, client in [*one.values(), *alone]]
    out = []
    for minute, kind in {(m, k) for m, k, _ in clicks}:
        own = [(m, c) for m, k, c in clicks if k == kind and c[0] and m <= minute]
        counts = [len({c for m, c in own if m > minute - w}) for w in windows.values()]
        often = Counter(c for m, c in own if m > minute - hot_window)
        out.append((kind, minute, *counts, sum(n >= hot for n in often.values())))
    return sorted(out)


@pytest.mark.parametrize("chunk,windows,hot,hot_window", [(64, {"a": 5, "b": 30, "c": 200}, 3, 200), (128, {"a": 1, "b": 64}, 1, 7), (32768, {"a": 30, "b": 5, "c": 10080}, 4, 90)])
def test_windows_equal_brute_force(spark, chunk, windows, hot, hot_window):
    rng = np.random.default_rng(chunk)
    rows = []
    for i in range(600):
        ts = START + timedelta(seconds=int(rng.integers(-9000, 40_000)))  # before 1970 too
        client = None if i % 17 == 0 else 7 if i % 3 == 0 else int(rng.integers(0, 40)) * (1 << 55)
        rows.append((None if i % 50 == 0 else i, None if i % 41 == 0 else ts, None if i % 37 == 0 else "ab"[i % 2] * (1 + 999 * (i % 5 == 0)), client, "x", "y"))
    rows += rows[:100] + [(3, START, "a", 1, "", ""), (3, START, "a", None, "", ""), (4, None, "b", 1, "", "")]
    got = r.rolling_users(spark.createDataFrame(rows, SCHEMA).repartition(5), windows, hot, hot_window, chunk)
    assert got.columns == ["kind", "minute", *windows, "hot_users"]
    assert sorted(tuple(x) for x in got.collect()) == brute(rows, windows, hot, hot_window)


def test_one_user_with_most_clicks_and_empty_table(spark):
    rows = [(i, START + timedelta(seconds=i), "a", 1 if i % 3 else i, "", "") for i in range(20_000)]
    got = {m: (a, h) for _, m, a, h in r.rolling_users(spark.createDataFrame(rows, SCHEMA), {"u": 2}, 3, 2, 64).collect()}
    assert got[100] == (41, 1) and len(got) == 334
    empty = r.rolling_users(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0 and empty.columns == ["kind", "minute", "users_short", "users_middle", "users_long", "hot_users"]
    with pytest.raises(ValueError):
        r.rolling_users(spark.createDataFrame([], SCHEMA), chunk=100)


def test_the_zone_of_the_session_changes_nothing(spark):
    rows = [(i, datetime(2024, 3, 10, 1) + timedelta(minutes=7 * i), "a", i % 5, "", "") for i in range(40)]
    want = sorted(tuple(x) for x in r.rolling_users(spark.createDataFrame(rows, SCHEMA)).collect())
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert sorted(tuple(x) for x in r.rolling_users(spark.createDataFrame(rows, SCHEMA)).collect()) == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert want[0][1] == (rows[0][1] - START) // timedelta(minutes=1)
