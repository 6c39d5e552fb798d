"""Incremental work as streams: file sources with checkpoints, seen-key removal, failures set aside, running counts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def rows_of(spark: SparkSession, folder: str, schema: str, files: int = 100) -> DataFrame:
    """A stream of the Parquet files that arrive in a folder, at most ``files`` at once."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def first_seen(stream: DataFrame, key: str | list[str], time: str, late: str = "1 day") -> DataFrame:
    """The stream without rows of a key seen before, within the watermark: a key is forgotten ``late`` after its event."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key] if isinstance(key, str) else key)


def running_counts(stream: DataFrame, by: list[str]) -> DataFrame:
    return stream.groupBy(*by).agg(F.count("*").alias("n"))


def windowed(stream: DataFrame, time: str, by: list[str], size: str, late: str) -> DataFrame:
    """Counts of each window, final once the watermark has passed it."""
    return stream.withWatermark(time, late).groupBy(F.window(time, size), *by).agg(F.count("*").alias("n"))


def failing(batch: DataFrame, work: Callable[[DataFrame], DataFrame], tries: int, isolate: int) -> list[tuple[int, int, str]]:
    """(bits, rest, reason) of the parts of batch whose work fails ``tries`` times: rows whose hash has this rest by 2**bits.
    A part that fails is halved until its rows are all equal, so only rows that fail themselves are left, as long as there are
    fewer than ``isolate`` parts; from then on a failing part stays whole."""
    todo, bad = [(0, 0)], []

    def reason(part: DataFrame) -> str | None:
        try:
            work(part).write.format("noop").mode("overwrite").save()
        except Exception as why:  # whatever the work raises is the row's reason
            return str(why)[:500]
        return None

    while todo:
        bits, rest = todo.pop()
        part = batch.where(_in_part(batch, bits, rest))
        why = reason(part)
        if why is None:
            continue
        if bits < 62 and len(bad) + len(todo) < isolate and part.distinct().limit(2).count() > 1:
            todo += [(bits + 1, rest), (bits + 1, rest + (1 << bits))]
            continue
        for _ in range(tries - 1):
            why = why and reason(part)
        if why is not None:
            bad.append((bits, rest, why))
    return bad


def _in_part(batch: DataFrame, bits: int, rest: int) -> Column:
    return F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in batch.columns]), F.lit(1 << bits)) == rest


def process(stream: DataFrame, work: Callable[[DataFrame], DataFrame], ok: str, failed: str, checkpoint: str, tries: int = 3, isolate: int = 64) -> StreamingQuery:
    """Runs ``work``, which treats rows one by one, on every batch and adds its result to ``ok``. If a batch fails, the rows at
    fault are found by halving it: the others' result is added, and each row that fails ``tries`` times goes to ``failed``
    with its reason and the number of tries. Neither stops the stream. A batch of over ``isolate`` faults keeps the parts that
    were not halved to the end together. A restarted query goes on after the last finished batch. A batch has a
    folder of its own number, so one that runs again, after a failure half way or a restart, replaces what it wrote."""

    def each(batch: DataFrame, number: int) -> None:
        good, at = batch, f"{ok}/batch={number}"
        try:
            work(batch).write.mode("overwrite").parquet(at)
            return
        except Exception:  # which rows is found out below
            bad = failing(batch, work, tries, isolate)
        lost = None

        def aside(part: DataFrame, why: str) -> None:
            nonlocal lost
            part = part.withColumns({"reason": F.lit(why), "tries": F.lit(tries)})
            lost = part if lost is None else lost.unionAll(part)

        for bits, rest, why in bad:
            here = _in_part(batch, bits, rest)
            good = good.where(~here)
            aside(batch.where(here), why)
        try:
            work(good).write.mode("overwrite").parquet(at)
        except Exception as why:  # work that fails by itself, whatever the rows
            aside(good, str(why)[:500])
        if lost is not None:
            lost.write.mode("overwrite").parquet(f"{failed}/batch={number}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _tried(rows: pd.DataFrame, work: Callable[[pd.DataFrame], pd.DataFrame], tries: int) -> Iterator[tuple[pd.DataFrame, str | None]]:
    """(result, None) of parts of rows that work, and (row, reason) of each row that fails by itself ``tries`` times."""
    todo = [rows]
    while todo:
        part = todo.pop()
        for left in range(tries if len(part) == 1 else 1, 0, -1):
            try:
                yield work(part), None
                break
            except Exception as why:  # whatever the work raises is the row's reason
                if len(part) > 1:
                    todo += [part[len(part) // 2 :], part[: len(part) // 2]]
                elif left == 1:
                    yield part, str(why)[:500]


def process_rows(stream: DataFrame, work: Callable[[pd.DataFrame], pd.DataFrame], schema: str, ok: str, failed: str, checkpoint: str, tries: int = 3) -> StreamingQuery:
    """``process`` for work in Python that treats the rows of a frame one by one and gives rows of ``schema``. A task halves the
    frames that fail, so any number of faults are each set aside by themselves in one pass over a batch."""
    given = stream.schema
    out = f"done struct<{schema}>, row {given.simpleString()}, reason string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in frames:
            for part, why in _tried(rows, work, tries):
                lines, none = part.astype(object).where(part.notna(), None).to_dict("records"), [None] * len(part)
                yield pd.DataFrame({"done": lines if why is None else none, "row": none if why is None else lines, "reason": [why] * len(part)}, dtype=object)

    def each(batch: DataFrame, number: int) -> None:
        every = batch.mapInPandas(run, out)
        at = f"{ok}/batch={number}", f"{failed}/batch={number}"
        # one pass runs the work, and both tables are read from what it wrote
        whole = f"{checkpoint}-work/batch={number}"
        every.write.mode("overwrite").parquet(whole)
        every = batch.sparkSession.read.schema(every.schema).parquet(whole)
        every.where("reason is null").select("done.*").write.mode("overwrite").parquet(at[0])
        lost = every.where("reason is not null")
        if not lost.isEmpty():
            lost.select("row.*", "reason", F.lit(tries).alias("tries")).write.mode("overwrite").parquet(at[1])

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
