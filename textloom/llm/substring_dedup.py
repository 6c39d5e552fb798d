"""Incremental removal of repeated 50-word passages by a log-structured fingerprint index (operator 1).

The index is a set of immutable runs, tables in buckets by hash that are sorted by it, in two levels of detail:

* seed runs: the hash of the window's *seed*, its 25-word sub-window of least hash, with the first document that had
  it. Equal windows have equal seeds, and one seed stands for about thirteen windows, so seeds are few.
* window runs: 128-bit hashes of whole windows, with the smallest document in which each starts. A window enters once
  its seed is known from two documents; before, nothing can repeat it.

A batch of documents (ascending doc_id) merge-joins its seeds with the seed runs, then hashes the windows of shared
seeds, its own and those of the few historical documents that were alone with a seed until now, and merge-joins these
with the window runs. A match is verified by the second, independent 64 bits of the window's words. Then the batch's runs
are added, and runs are merged into one when there are more than ``fan_in`` of them. Neither the runs nor the texts are
dealt out again for any of this: they lie in buckets of the same hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string
from pyspark.sql.window import Window

from textloom.llm import _scratch
from textloom.llm._text import blocks, gram_hashes, gram_starts, word_hashes, words

WINDOW, SEED = 50, 25
#: Characters of text to a bucket.
PER_BUCKET = 32 << 20


def _window_seeds(codes: np.ndarray, at: np.ndarray, window: int, seed: int) -> np.ndarray:
    """For each window start: the least hash of the window's seed-word sub-windows."""
    h = gram_hashes(codes, seed, 3)
    span, low = window - seed + 1, h
    width = 1
    while 2 * width <= span:  # minimum over a sliding span by doubling
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    return np.minimum(low[at], low[at + span - width])


class _Block:
    """Words and windows of a run of whole documents."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, window: int, seed: int):
        self.starts, self.ends, self.first = words(data, offsets)
        self.codes = word_hashes(data, self.starts, self.ends)
        self.at, self.doc = gram_starts(self.first, window)
        self.seeds = _window_seeds(self.codes, self.at, window, seed) if len(self.at) else np.zeros(0, np.uint64)
        self.window = window

    def hashes(self, these: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = self.at[these]
        return gram_hashes(self.codes, self.window, 1)[at], gram_hashes(self.codes ^ np.uint64(0xA5A5A5A55A5A5A5A), self.window, 2)[at]


def _numbered(docs: DataFrame) -> DataFrame:
    """docs with ``row``: a hash of doc_id and text, which tells rows of one doc_id apart."""
    return docs if "row" in docs.columns else docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), "text")


def _seed_rows(docs: DataFrame, window: int, seed: int) -> DataFrame:
    """(seed, doc_id, row, several, seeds): the seeds of the documents' windows. A block of texts has one row for a seed, of the
    smallest document; several: others of the block have it too. What a document shares with others of its block is in one
    row of its own, as the list ``seeds``, dealt by its row: so a seed of very many documents is a row for each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for lo, hi, data, offsets in blocks(batch.column(2)):
                b = _Block(data, offsets, window, seed)
                if not len(b.at):
                    continue
                new = np.concatenate([[True], (b.seeds[1:] != b.seeds[:-1]) | (b.doc[1:] != b.doc[:-1])])
                own, doc = b.seeds[new], lo + b.doc[new]
                order = np.lexsort((rows[doc], ids[doc], own))
                own, doc = own[order], doc[order]
                head = np.concatenate([[True], own[1:] != own[:-1]])
                new = head.copy()  # repeats within a document, and of equal rows, go
                new[1:] |= (rows[doc[1:]] != rows[doc[:-1]]) | (ids[doc[1:]] != ids[doc[:-1]])
                own, doc, head = own[new], doc[new], np.flatnonzero(head[new])
                count = np.diff(np.append(head, len(own)))
                n = len(head)
                yield pa.RecordBatch.from_arrays([pa.array(own[head].view(np.int64)), pa.array(ids[doc[head]]), pa.array(rows[doc[head]]), pa.array(count > 1), pa.nulls(n, pa.list_(pa.int64()))], SEEDS)
                both = np.repeat(count > 1, count)
                own, doc = own[both], doc[both]
                if len(own):
                    order = np.argsort(doc, kind="stable")
                    own, doc = own[order], doc[order]
                    head = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
                    lists = pa.ListArray.from_arrays(pa.array(np.append(head, len(own)).astype(np.int32)), pa.array(own.view(np.int64)))
                    yield pa.RecordBatch.from_arrays([pa.array(rows[doc[head]]), pa.array(ids[doc[head]]), pa.array(rows[doc[head]]), pa.array(np.ones(len(head), dtype=bool)), lists], SEEDS)

    return docs.select("doc_id", "row", "text").mapInArrow(run, "seed long, doc_id long, row long, several boolean, seeds array<long>")


SEEDS = ["seed", "doc_id", "row", "several", "seeds"]
FOUND = "w long, v long, doc_id long, row long, sure boolean, at int, more array<int>"


def _window_rows(wanted: DataFrame, window: int, seed: int) -> DataFrame:
    """The distinct windows (w, v) of each document whose seed is in its list ``seeds``: at is the first word of one, more
    those of its repeats in the document. Within a block only a window's smallest documents keep its hash; what
    others have of it is sure to go: the first words of all these are one row of a document, dealt by its own hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            lists = batch.column(3)
            for lo, hi, data, offsets in blocks(batch.column(2)):
                b = _Block(data, offsets, window, seed)
                known = np.unique(lists.slice(lo, hi - lo).flatten().to_numpy().view(np.uint64))
                if not len(b.at) or not len(known):
                    continue
                these = np.flatnonzero(known[np.minimum(np.searchsorted(known, b.seeds), len(known) - 1)] == b.seeds)
                if not len(these):
                    continue
                w, v = b.hashes(these)
                doc, at = b.doc[these], b.at[these] - b.first[:-1][b.doc[these]]
                doc_id = ids[lo + doc]
                order = np.lexsort((at, doc, doc_id, v, w))
                w, v, doc, at, doc_id = w[order], v[order], doc[order], at[order], doc_id[order]
                same = np.concatenate([[False], (w[1:] == w[:-1]) & (v[1:] == v[:-1])])
                head = np.maximum.accumulate(np.where(same, 0, np.arange(len(w))))
                sure = doc_id > doc_id[head]  # a smaller document has it in this very block
                again = same & ~sure & np.concatenate([[False], doc[1:] == doc[:-1]])  # the row before says where too
                first = np.flatnonzero(~sure & ~again)
                repeats = np.add.reduceat(again, first, dtype=np.int64) if len(first) else np.zeros(0, np.int64)
                offset = np.concatenate([[0], np.cumsum(repeats)]).astype(np.int32)
                more = pa.ListArray.from_arrays(pa.array(offset), pa.array(at[again].astype(np.int32)), mask=pa.array(repeats == 0))
                n = len(first)
                yield pa.RecordBatch.from_arrays([pa.array(w[first].view(np.int64)), pa.array(v[first].view(np.int64)), pa.array(doc_id[first]), pa.array(rows[lo + doc[first]]), pa.array(np.zeros(n, dtype=bool)), pa.array(at[first].astype(np.int32)), more], NAMES)
                if sure.any():
                    own, place = doc[sure], at[sure].astype(np.int32)
                    order = np.argsort(own, kind="stable")
                    own, place = own[order], place[order]
                    head = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                    n, own = len(head), lo + own[head]
                    more = pa.ListArray.from_arrays(pa.array(np.append(head, len(place)).astype(np.int32)), pa.array(place))
                    yield pa.RecordBatch.from_arrays([pa.array(rows[own]), pa.array(rows[own]), pa.array(ids[own]), pa.array(rows[own]), pa.array(np.ones(n, dtype=bool)), pa.nulls(n, pa.int32()), more], NAMES)

    return wanted.select("doc_id", "row", "text", "seeds").mapInArrow(run, FOUND)


NAMES = ["w", "v", "doc_id", "row", "sure", "at", "more"]


class FingerprintIndex:
    """The runs of an index in the shared folder. ``add`` gives a batch's repeated windows and grows the index.

    A run is a table in ``parts`` buckets by hash, each sorted by it, and has a hash once. A batch's own rows are dealt to
    such buckets once; its merge-joins with the runs, and those by which ``compact`` merges runs, exchange nothing.
    """

    KEYS = {"seed": ["seed"], "window": ["w", "v"]}

    def __init__(self, spark: SparkSession, window: int = WINDOW, seed: int = SEED, fan_in: int = 3, parts: int | None = None):
        self.spark, self.window, self.seed, self.fan_in = spark, window, seed, fan_in
        self.parts = parts or _scratch.parts_for(spark, 0, 1)
        self.runs: dict[str, list[str]] = {"seed": [], "window": []}
        self.kept: DataFrame | None = None

    def _write(self, kind: str, rows: DataFrame) -> None:
        self.runs[kind].append(_scratch.bucketed(rows, f"{kind}-run", self.KEYS[kind], self.parts, placed=True))

    def compact(self, kind: str) -> None:
        """Merges all runs of a kind into one when they are more than fan_in; the old ones go."""
        if len(self.runs[kind]) <= self.fan_in:
            return
        old, key = self.runs[kind], self.KEYS[kind]
        merged = self.spark.table(old[0])
        for run in old[1:]:
            a, b = merged.alias("a"), self.spark.table(run).alias("b")
            both = a.join(b, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in key], "full_outer")
            keys = [F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in key]
            if kind == "seed":  # an older run's document is the first
                merged = both.select(*keys, F.coalesce("a.first", "b.first").alias("first"), (F.coalesce("a.shared", F.lit(False)) | F.coalesce("b.shared", F.lit(False))).alias("shared"), F.lit(False).alias("alone"))
            else:
                merged = both.select(*keys, F.coalesce("a.doc_id", "b.doc_id").alias("doc_id"))
        self.runs[kind] = []
        self._write(kind, merged)
        for run in old:
            _scratch.drop_bucketed(self.spark, run)

    def drop(self) -> None:
        for run in self.runs["seed"] + self.runs["window"]:
            _scratch.drop_bucketed(self.spark, run)
        self.runs = {"seed": [], "window": []}

    def add(self, batch: DataFrame, history: DataFrame | None, last: bool = False) -> DataFrame:
        """(doc_id, row, at): starts of windows of batch whose words also start in a document of smaller doc_id, in the
        batch or in the index. batch, history: (doc_id, text), perhaps with row, of the new and of all indexed documents;
        doc_ids of the batch are larger than those of the history. last: no batch follows, so windows and merged runs are not
        written."""
        batch, history = _numbered(batch), None if history is None else _numbered(history)
        rows = _scratch.placed(_seed_rows(batch, self.window, self.seed), ["seed"], self.parts)
        one = F.struct("doc_id", "row")
        state = rows.where("seeds is null").groupBy("seed").agg(F.min(one).alias("low"), (F.max("several") | (F.min(one) < F.max(one))).alias("several"))
        first, was = F.lit(None).cast("struct<doc_id:bigint,row:bigint>"), F.lit(False)
        for k, run in enumerate(self.runs["seed"]):
            past = self.spark.table(run).select("seed", F.col("first").alias(f"first{k}"), F.col("shared").alias(f"shared{k}"))
            state = state.join(past, "seed", "left")
            first, was = F.coalesce(first, f"first{k}"), was | F.coalesce(f"shared{k}", F.lit(False))
        # a run has all of its batch's seeds; alone: one historical document had it until now
        shared = F.col("several") | first.isNotNull()
        state = state.select("seed", F.coalesce(first, "low").alias("first"), shared.alias("shared"), (first.isNotNull() & ~was).alias("alone"))
        self._write("seed", state)
        state = self.spark.table(self.runs["seed"][-1]).where("shared")
        need = rows.where("seeds is null and not several").join(state.select("seed"), "seed").select("doc_id", "row", "seed")
        need = need.unionAll(rows.where("seeds is not null").select("doc_id", "row", F.explode("seeds").alias("seed")))
        text, path = batch, None
        if history is not None:
            old = state.where("alone").select("first.doc_id", "first.row", "seed")
            need = need.unionAll(old)
            path, ids = _scratch.written_at(old.select("doc_id", "row").distinct(), "first-docs")
            # broadcast only a checked, small set of ids
            text = text.unionAll(history.select(*text.columns).join(F.broadcast(ids) if ids.count() <= 1_000_000 else ids, ["doc_id", "row"], "left_semi").select(*text.columns))
        need = need.groupBy("doc_id", "row").agg(F.collect_set("seed").alias("seeds"))  # as many as a text's words at most
        found = _window_rows(text.join(need, ["doc_id", "row"]), self.window, self.seed)
        low = self._last_hits(found) if last else self._hits_and_run(found)
        if not last:  # the windows are there, so their seeds can go
            rows.unpersist(True)
            _scratch.release(self.spark)
        none = F.array().cast("array<int>")
        at = F.explode(F.concat(F.when(F.col("at").isNull(), none).otherwise(F.array("at")), F.coalesce("more", none))).alias("at")
        hit = _scratch.written(low.where("sure or doc_id > low").select("doc_id", "row", at).hint("rebalance"), "repeats")
        rows.unpersist(True)
        if self.kept is not None:
            self.kept.unpersist(True)
            self.kept = None
        if path:
            _scratch.drop(self.spark, path)
        if not last:
            self.compact("seed")
            self.compact("window")
        return hit

    def _with_runs(self, rows: DataFrame) -> tuple[DataFrame, list]:
        """rows with the smallest document that each run knows of their window, and these columns."""
        columns = []
        for k, run in enumerate(self.runs["window"]):
            rows = rows.join(self.spark.table(run).select("w", "v", F.col("doc_id").alias(f"low{k}")), ["w", "v"], "left")
            columns.append(F.col(f"low{k}"))
        return rows, columns

    def _hits_and_run(self, found: DataFrame) -> DataFrame:
        """found with low, the smallest document of its window in the batch and the index; adds the batch's run."""
        self.kept = found = _scratch.placed(found, ["w", "v"], self.parts)
        own, past = self._with_runs(found.where("not sure").groupBy("w", "v").agg(F.min("doc_id").alias("low")))
        self._write("window", own.select("w", "v", (F.least("low", *past) if past else F.col("low")).alias("doc_id")))
        low = self.spark.table(self.runs["window"][-1]).withColumnRenamed("doc_id", "low")
        return found.join(low, ["w", "v"], "left")

    def _last_hits(self, found: DataFrame) -> DataFrame:
        """found with low, in one pass as no run is written: a window has at most a row of each block of texts."""
        own, past = self._with_runs(found.repartition(self.parts, "w", "v"))
        low = F.min(F.when(~F.col("sure"), F.col("doc_id"))).over(Window.partitionBy("w", "v"))
        return own.withColumn("low", F.least(low, *past) if past else low)


def _covered(batches: Iterator[pa.RecordBatch], window: int, rest: bool) -> Iterator[pa.RecordBatch]:
    """Removes the words that the windows at the given starts cover."""
    for batch in batches:
        n_words, n_removed, digests, texts = [], [], [], []
        starts_of = batch.column(2)
        for lo, hi, data, offsets in blocks(batch.column(1)):
            starts, ends, first = words(data, offsets)
            total = len(starts)
            marks = np.zeros(total + window + 1, dtype=np.int64)
            part = starts_of.slice(lo, hi - lo)
            sizes = part.value_lengths().fill_null(0).to_numpy()
            at = part.flatten().to_numpy().astype(np.int64) + np.repeat(first[:-1], sizes)
            np.add.at(marks, at, 1)
            np.add.at(marks, at + window, -1)
            gone = np.cumsum(marks)[:total] > 0
            raw = data.tobytes()
            removed = np.add.reduceat(np.concatenate([gone, [False]]).astype(np.int64), first[:-1]) if len(first) > 1 else np.zeros(0, np.int64)
            for k in range(hi - lo):
                a, z = int(first[k]), int(first[k + 1])
                some = int(removed[k]) if z > a else 0
                if some:
                    kept = b" ".join([raw[starts[i] : ends[i]] for i in np.flatnonzero(~gone[a:z]) + a])
                else:
                    kept = b" ".join(raw[offsets[k] : offsets[k + 1]].split())
                n_words.append(z - a)
                n_removed.append(some)
                if rest:
                    texts.append(kept if some else None)
                else:
                    digests.append(hashlib.sha256(kept).hexdigest())
        counts = [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())]
        if rest:
            yield pa.RecordBatch.from_arrays([batch.column(3), batch.column(1), *counts, pa.array(texts, pa.binary()).cast(pa.string())], ["rest", "text", "n_words", "n_removed", "kept_text"])
        else:
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array(digests, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def _split(docs: DataFrame, batches: int, window: int, rest: bool) -> DataFrame:
    """Rows of docs with the starts of their repeated windows taken out by ``_covered``."""
    spark = docs.sparkSession
    others = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *([others.alias("rest")] if rest else []))
    size, cuts = docs.agg(F.sum(F.length("text")), F.percentile_approx("doc_id", [k / batches for k in range(1, max(2, batches))], 10_000)).first()
    parts = min(_scratch.parts_for(spark, size or 0, PER_BUCKET), _scratch.MOST_BUCKETS)
    numbered = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), "text", *(["rest"] if rest else []))
    whole = spark.table(_scratch.bucketed(numbered, "documents", ["doc_id", "row"], parts))
    _scratch.release(spark)
    texts = whole.where("doc_id is not null").select("doc_id", "row", "text")
    cuts = [None, *dict.fromkeys(cuts or []), None] if batches > 1 else [None, None]
    index, found = FingerprintIndex(spark, window, fan_in=1, parts=parts), None
    for k, (low, high) in enumerate(zip(cuts, cuts[1:], strict=False)):
        mine = texts if low is None else texts.where(F.col("doc_id") > low)
        mine = mine if high is None else mine.where(F.col("doc_id") <= high)
        hit = index.add(mine, None if low is None else texts.where(F.col("doc_id") <= low), last=k == len(cuts) - 2)
        found = hit if found is None else found.unionAll(hit)
        _scratch.release(spark)
    index.drop()
    found = found.groupBy("doc_id", "row").agg(F.collect_set("at").alias("starts"))
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string"
    if rest:
        schema = StructType([whole.schema["rest"], whole.schema["text"], *_parse_datatype_string("n_words long, n_removed long, kept_text string").fields])
    return whole.join(found, ["doc_id", "row"], "left").select("doc_id", "text", "starts", *(["rest"] if rest else [])).mapInArrow(lambda b: _covered(b, window, rest), schema)


def remove_repeats(docs: DataFrame, batches: int = 3, window: int = WINDOW, text_out: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept_text]) of every document.

    A word goes if a window of ``window`` consecutive words that covers it also starts in a document of smaller doc_id;
    windows are judged on the input. Kept words are joined by one space. kept_text (with text_out) is null where nothing
    was removed. The documents enter the index in ``batches`` batches of ascending doc_id. A null or empty text has no
    words; a document shorter than the window loses nothing; rows of one doc_id, of equal or of different texts, don't
    repeat each other and are each judged by their own text; rows of a null doc_id are kept whole and teach the index
    nothing; an empty table gives no rows; other columns are not read.

    Texts are dealt once to buckets by doc_id and a hash of the text; all that follows moves ids, hashes and places only.
    """
    if not text_out:
        return _split(docs, batches, window, False)
    out = _split(docs.select("doc_id", "text"), batches, window, True)
    whole = F.array_join(F.filter(F.split(F.coalesce("kept_text", "text", F.lit("")), "[ \t-\r]+"), lambda w: w != ""), " ")
    return out.select(F.col("rest.doc_id").cast("long").alias("doc_id"), "n_words", "n_removed", F.sha2(whole, 256).alias("kept_sha256"), "kept_text")


def without_repeats(docs: DataFrame, batches: int = 3, window: int = WINDOW) -> DataFrame:
    """docs, with their columns, without the words that ``remove_repeats`` removes. A text that loses words has the others
    joined by one space, and its n_chars, if docs have such a column, is its length; one that loses all its words goes with its row; any
    other row stays as it is, null and empty texts and null doc_ids included. An empty table gives no rows."""
    out = _split(docs, batches, window, True).where(F.col("kept_text").isNull() | (F.col("kept_text") != ""))
    text = F.coalesce("kept_text", "text").alias("text")
    columns = [text if c == "text" else F.col(f"rest.`{c}`") for c in docs.columns]
    if "n_chars" in docs.columns:
        size = F.when(F.col("kept_text").isNull(), F.col("rest.n_chars")).otherwise(F.length("kept_text").cast(docs.schema["n_chars"].dataType)).alias("n_chars")
        columns = [size if c == "n_chars" else x for c, x in zip(docs.columns, columns, strict=True)]
    return out.select(*columns)
