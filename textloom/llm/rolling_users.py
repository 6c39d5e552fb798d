"""Distinct users over trailing windows of minutes, by bitsets of their timelines (operator 13).

A user's clicks of a kind are a big integer with one bit for each minute, cut into chunks of CHUNK minutes. A chunk's
integer begins a window before the chunk, so that it needs no other chunk. Its 64-bit limbs are a column of a matrix, and a
block of users is worked on at once:

* trailing windows of L minutes: the integer is dilated, x |= x << h for h doubling up to L;
* at least k clicks in a window: k thermometer planes (at least 1, 2, ... clicks), joined for windows that lie end to end;
* windows of up to 64 minutes touch the limbs with clicks and those after them alone, so they are worked on in these limbs;
  longer ones begin from them and move by whole limbs only;
* each run of set bits counts its user from its first minute to its last one: the runs' edges, +1 and -1, are summed over the
  users of a chunk, and a prefix sum over the chunk's minutes gives the users of each. No chunk needs the sum of another one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType
from pyspark.sql.window import Window

from textloom.llm._runs import by_runs

#: Minutes of a chunk, a multiple of 64; limbs of a block of users.
CHUNK, LIMBS = 32_768, 1 << 14
WINDOWS = {"users_short": 5, "users_middle": 30, "users_long": 10_080}
_U = np.uint64


Later = Callable[[np.ndarray, int], tuple[int, np.ndarray]]


def _later(x: np.ndarray, by: int) -> tuple[int, np.ndarray]:
    """(limbs, y): each column's integer (little-endian limbs down the rows) times 2**by is y, limbs further on."""
    limbs, bits = divmod(by, 64)
    if not bits:
        return limbs, x
    y = x << _U(bits)
    y[1:] |= x[:-1] >> _U(64 - bits)
    return limbs, y


def _limbs_later(x: np.ndarray, by: int) -> tuple[int, np.ndarray]:
    return by, x


def dilated(x: np.ndarray, have: int, length: int, later: Later = _later) -> np.ndarray:
    """The minutes whose window of ``length`` holds a click, from those whose window of ``have`` minutes does. later: how
    integers move by so many minutes, or by another unit in which have and length are given."""
    while have < length:
        step = min(have, length - have)
        limbs, y = later(x, step)
        x = x.copy()
        x[limbs:] |= y[: max(0, len(x) - limbs)]
        have += step
    return x


def _joined(a: list[np.ndarray], b: list[np.ndarray], by: int, later: Later) -> list[np.ndarray]:
    """Thermometer planes of two windows that lie end to end, from the planes of the later one and those of the older one,
    ``by`` minutes before: k clicks are i in one and k - i in the other."""
    out, older = [], []
    for k in range(len(a)):
        limbs, y = later(b[k], by)
        older.append(y[: max(0, len(y) - limbs)])
        x = a[k].copy()
        rest = x[limbs:]
        rest |= older[k]
        for i in range(k):
            rest |= a[i][limbs:] & older[k - 1 - i]
        out.append(x)
    return out


def thermometer(planes: list[np.ndarray], length: int, later: Later = _later) -> list[np.ndarray]:
    """Planes of the trailing window of ``length`` minutes, from those of single minutes; plane k - 1 is set where the window
    has at least k clicks. Windows of powers of two are joined end to end. later: as in ``dilated``."""
    total, have, width = None, 0, 1
    while True:
        if length & width:
            total = planes if total is None else _joined(total, planes, have, later)
            have += width
        if have == length:
            return total
        planes = _joined(planes, planes, width, later)
        width *= 2


def _summed(limb: np.ndarray, change: np.ndarray, own: np.ndarray, limbs: int) -> np.ndarray:
    """For each minute: how many runs begin there less how many ended just before. change: the bits of limbs of ``own`` that
    differ from the bit before."""
    sums = np.zeros(limbs * 64, dtype=np.int64)
    some = change != 0
    limb, v, own = limb[some], change[some], own[some]
    while len(v):
        bit = v & (~v + _U(1))
        sums += np.bincount(limb * 64 + np.bitwise_count(bit - _U(1)), np.where(own & bit, 1, -1), len(sums)).astype(np.int64)
        v = v ^ bit
        left = v != 0
        v, limb, own = v[left], limb[left], own[left]
    return sums


def _changes(own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(limb, change, own) of the limbs of a chunk's columns in which runs begin or end."""
    change = own ^ _later(own, 1)[1]
    at = np.flatnonzero(change)
    return at // own.shape[1], change.ravel()[at], own.ravel()[at]


def edges(own: np.ndarray) -> np.ndarray:
    """For each minute of a chunk: the columns whose runs begin there, less those whose runs ended just before."""
    return _summed(*_changes(own), len(own))


class _Near:
    """The limbs of some users' integers with clicks and the limbs after them, users one after the other."""

    def __init__(self, user: np.ndarray, at: np.ndarray, n: np.ndarray, planes: int, limbs: int):
        place = user * limbs + (at >> 6)
        new = np.concatenate([[True], place[1:] != place[:-1]])
        own = place[new]
        active = np.union1d(own, own[own % limbs < limbs - 1] + 1)
        self.user, self.limb, self.limbs = active // limbs, active % limbs, limbs
        self.follows = (np.concatenate([[-2], active[:-1]]) + 1 == active) & (self.limb > 0)
        bit, index = _U(1) << (at & 63).astype(np.uint64), np.searchsorted(active, own)
        self.planes = []
        for k in range(planes):
            x = np.zeros(len(active), dtype=np.uint64)
            x[index] = np.bitwise_or.reduceat(np.where(n > k, bit, _U(0)), np.flatnonzero(new))
            self.planes.append(x)

    def later(self, x: np.ndarray, by: int) -> tuple[int, np.ndarray]:
        """x moved by up to 63 minutes."""
        y = x << _U(by)
        y[1:] |= np.where(self.follows[1:], x[:-1] >> _U(64 - by), _U(0))
        return 0, y

    def edges(self, x: np.ndarray, halo: int) -> np.ndarray:
        before = np.where(self.limb == halo, _U(0), self.later(x, 1)[1] & _U(1)) | x << _U(1)
        own = self.limb >= halo
        return _summed(self.limb[own] - halo, (x ^ before)[own], x[own], self.limbs - halo)

    def spread(self, x: np.ndarray, users: np.ndarray) -> np.ndarray:
        """The whole integers of x for ``users``, ascending, as columns."""
        out = np.zeros((self.limbs, len(users)), dtype=np.uint64)
        lo, hi = np.searchsorted(self.user, [users[0], users[-1] + 1])
        column = np.searchsorted(users, self.user[lo:hi])
        these = users[column] == self.user[lo:hi]
        out[self.limb[lo:hi][these], column[these]] = x[lo:hi][these]
        return out


class _Sums:
    """Summed edges of a chunk of a kind, block by block of its users."""

    def __init__(self, windows: list[int], hot: int, hot_window: int, chunk: int):
        self.windows, self.hot, self.hot_window, self.chunk = windows, hot, hot_window, chunk
        self.halo = -(-(max([*windows, hot_window]) - 1) // 64)  # limbs before the chunk
        self.users = max(1, LIMBS // (self.halo + chunk // 64))
        self.sums = np.zeros((len(windows) + 1, chunk), dtype=np.int64)
        self.here = np.zeros(chunk, dtype=bool)

    def add(self, user: np.ndarray, minute: np.ndarray, n: np.ndarray) -> None:
        """user: ascending numbers from 0; minute: from the chunk's beginning, before it negative; n: clicks, up to hot."""
        at, users = minute + 64 * self.halo, int(user[-1]) + 1
        near = _Near(user, at, n, self.hot, self.halo + self.chunk // 64)
        near_one = near.planes[0]
        unit = dilated(near_one, 1, 64, near.later)
        found: list[list] = [[] for _ in self.sums]
        parts = [dilated(near_one, 1, w % 64, near.later) if w % 64 else None for w in self.windows]
        for k, w in enumerate(self.windows):
            if w < 64:
                self.sums[k] += near.edges(parts[k], self.halo)
        long = [k for k in np.argsort(self.windows, kind="stable") if self.windows[k] >= 64]
        for lo in range(0, users if long else 0, self.users):
            these = np.arange(lo, min(lo + self.users, users))
            far, have = near.spread(unit, these), 1
            for k in long:
                limbs = self.windows[k] // 64
                far, have = dilated(far, have, limbs, _limbs_later), limbs
                x = far
                if parts[k] is not None:
                    x = far.copy()
                    x[limbs:] |= near.spread(parts[k], these)[: max(0, len(far) - limbs)]
                found[k].append(_changes(x[self.halo :]))
        # only users who ever have hot clicks within a window need planes
        each = np.repeat(np.arange(len(at)), n)
        late, early = each[self.hot - 1 :], each[: max(0, len(each) - self.hot + 1)]
        often = np.unique(user[late[(user[late] == user[early]) & (at[late] - at[early] < self.hot_window)]])
        limbs, rest = divmod(self.hot_window, 64)
        part = thermometer(near.planes, rest, near.later) if rest and len(often) else []
        if not limbs and part:
            self.sums[-1] += near.edges(part[-1], self.halo)
        units = thermometer(near.planes, 64, near.later) if limbs and len(often) else []
        for lo in range(0, len(often) if limbs else 0, self.users):
            these = often[lo : lo + self.users]
            planes = thermometer([near.spread(x, these) for x in units], limbs, _limbs_later)
            if rest:
                planes = _joined(planes, [near.spread(x, these) for x in part], limbs, _limbs_later)
            found[-1].append(_changes(planes[-1][self.halo :]))
        for k, own in enumerate(found):
            if own:
                self.sums[k] += _summed(*(np.concatenate(c) for c in zip(*own, strict=True)), self.chunk // 64)


def _edge_rows(rows: DataFrame, windows: dict[str, int], hot: int, hot_window: int, chunk: int) -> DataFrame:
    """(kind, chunk, minute, here, a sum of edges for each window, and for hot) from rows sorted by kind, chunk and user."""
    names = [*windows, "hot_users"]
    schema = "kind string, chunk long, minute long, here boolean, " + ", ".join(f"{n} long" for n in names)
    fields = ["kind", "chunk", "minute", "here", *names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple | None = None
        sums: _Sums | None = None

        def done() -> Iterator[pa.RecordBatch]:
            if sums is not None:
                at = np.flatnonzero(sums.here | (sums.sums != 0).any(axis=0))
                cols = [pa.array([now[0]] * len(at), pa.string()), pa.array(np.full(len(at), now[1], dtype=np.int64)), pa.array(at + now[1] * chunk), pa.array(sums.here[at])]
                yield pa.RecordBatch.from_arrays([*cols, *(pa.array(s[at]) for s in sums.sums)], fields)

        def work(table: pa.Table, first: np.ndarray) -> Iterator[pa.RecordBatch]:
            nonlocal now, sums
            kind, part, known, minute, n = (table.column(c).to_numpy() for c in ("kind", "chunk", "known", "minute", "n"))
            user = np.zeros(table.num_rows, dtype=np.int64)
            user[first] = 1
            user = np.cumsum(user) - 1
            cut = np.flatnonzero((kind[1:] != kind[:-1]) | (part[1:] != part[:-1])) + 1
            for a, z in zip(np.concatenate([[0], cut]), np.append(cut, table.num_rows), strict=True):
                if now != (kind[a], part[a]):
                    yield from done()
                    now, sums = (kind[a], int(part[a])), _Sums(list(windows.values()), hot, hot_window, chunk)
                at = minute[a:z] - part[a] * chunk
                sums.here[at[at >= 0]] = True
                these = known[a:z]
                if these.any():
                    own = user[a:z][these]
                    sums.add(np.cumsum(np.concatenate([[0], own[1:] != own[:-1]])), at[these], n[a:z][these])

        yield from by_runs(batches, 4, work)
        yield from done()

    return rows.select("kind", "chunk", "known", "client", "minute", "n").mapInArrow(run, schema)


def _minute(clicks: DataFrame) -> Column:
    """Minutes since 1970 of ts, floored; a timestamp without a zone is read as UTC, whatever the session's zone."""
    if isinstance(clicks.schema["ts"].dataType, TimestampNTZType):
        days = F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date")).cast("long")
        return days * 1440 + F.hour("ts") * 60 + F.minute("ts")
    return F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(60_000_000)).cast("long")


def rolling_users(clicks: DataFrame, windows: dict[str, int] | None = None, hot: int = 3, hot_window: int = 10_080, chunk: int = CHUNK) -> DataFrame:
    """(kind, minute, a column for each of ``windows``, hot_users) for every pair of kind and minute that holds a click.

    A window's column counts the distinct users with a click of the kind in the last so many minutes, this one included;
    hot_users those with at least ``hot`` clicks in the last ``hot_window`` minutes. Rows of one click_id are one click; if
    they differ, it is the least of them by minute, kind and client_id (null first). A row of null click_id is a click of its
    own. Clicks of null ts or kind take no part; one of null client_id only makes its minute be listed. Repeated rows change
    nothing; an empty table gives no rows; other columns are not read.

    Clicks are summed by kind, user and minute before they are dealt by kind, chunk and a share of the users, so a user or a
    kind with most of the clicks is spread over chunks, and a user has at most a row for each minute of a chunk and of the
    window before. What the tasks give are sums by minute, however many users there are.
    """
    windows = windows or WINDOWS
    spark = clicks.sparkSession
    if chunk % 64 or min([hot, hot_window, *windows.values()]) < 1:
        raise ValueError("chunk must be a multiple of 64, hot and all windows at least 1")
    rows = clicks.select(F.col("click_id").cast("long").alias("click_id"), _minute(clicks).alias("minute"), F.col("kind").cast("string").alias("kind"), F.col("client_id").cast("long").alias("client")).where("minute is not null and kind is not null")
    # a row without an id is told apart by its place
    own = F.when(F.col("click_id").isNull(), F.monotonically_increasing_id())
    once = rows.groupBy("click_id", own.alias("own")).agg(F.min(F.struct("minute", "kind", "client")).alias("c")).select("c.*")
    each = once.groupBy("kind", "client", "minute").agg(F.least(F.count("*"), F.lit(hot)).cast("int").alias("n"))
    reach = max([*windows.values(), hot_window]) - 1
    parts = F.explode(F.sequence(F.floor(F.col("minute") / chunk), F.floor((F.col("minute") + F.when(F.col("client").isNull(), 0).otherwise(reach)) / chunk))).alias("chunk")
    dealt = each.select("kind", parts, F.col("client").isNotNull().alias("known"), F.coalesce("client", F.lit(0)).alias("client"), "minute", "n")
    shares = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8)
    dealt = dealt.repartition("kind", "chunk", F.pmod(F.xxhash64("client"), F.lit(shares))).sortWithinPartitions("kind", "chunk", "known", "client", "minute")
    names = [*windows, "hot_users"]
    sums = _edge_rows(dealt, windows, hot, hot_window, chunk).groupBy("kind", "chunk", "minute").agg(F.max("here").alias("here"), *[F.sum(n).alias(n) for n in names])
    upto = Window.partitionBy("kind", "chunk").orderBy("minute").rowsBetween(Window.unboundedPreceding, 0)
    return sums.select("kind", "minute", "here", *[F.sum(n).over(upto).alias(n) for n in names]).where("here").drop("here")
