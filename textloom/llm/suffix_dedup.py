"""Removal of repeated strings of bytes by merging Burrows-Wheeler transforms of shards (operator 12).

Two equal strings of LENGTH bytes have the same *anchor*: of all their substrings of GRAM bytes, the first of least hash. The
windows of a text that share an anchor are one *piece* of text, of under twice the length. Pieces are dealt by their anchor, so
all equal windows come together, and a piece meets only those that it can have windows in common with:

* equal pieces of an anchor: all but those of the smallest document are repeats as a whole;
* different pieces of an anchor: anchors are gathered into tasks, their pieces into shards; each shard's transform is built,
  and the transforms are merged by refinement of the interleave (``bwt``). Windows in one repeated interval are equal; those
  that don't start first are repeats;
* an anchor of very many different pieces, as at the edge of a passage that a third of all documents hold, would be too much
  for a task: its windows are dealt one by one, each by a hash of all its bytes. Such anchors are found in a part of the
  documents; which ones these are decides where windows meet, never the result.

Pieces without others of their anchor never enter a transform.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import _scratch, bwt
from textloom.llm._runs import by_runs
from textloom.llm._text import CHUNK, _byte_codes, blocks, gram_hashes, mix, powers

LENGTH, GRAM = 100, 40
#: One of so many documents is looked at for anchors of very many different pieces; pieces there from which an anchor is one;
#: anchors that are told to all tasks at most, those of most pieces.
PART, HOT, MOST = 16, 64, 50_000
#: Bytes of texts whose pieces are combined before they are dealt, of pieces to a partition, and of pieces to a shard.
COMBINED, PER_TASK, PER_SHARD = 4 << 20, 8 << 20, 64 << 10
#: Pieces whose transforms are merged together, but for anchors of more; what a merge works on then fits a core's cache.
TOGETHER = 1500
#: The lead of a window that is dealt alone.
ALONE = 4095
_U = np.uint64
_LOW = (1 << 16) - 1


class _Prefix:
    """Hashes of substrings of some bytes."""

    def __init__(self, data: np.ndarray, seed: int):
        base = 0x9E3779B97F4A7C15 + 2 * seed
        p, self.inverse = powers(base, len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(_byte_codes(seed)[data] * p[:-1], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix(mix((self.sums[ends] - self.sums[starts]) * self.inverse[starts]) + (ends - starts).astype(np.uint64))


def _pieces(data: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(start, windows, lead, anchor, piece) of the pieces of up to CHUNK bytes of texts: the first window's start, their number,
    how far the anchor lies behind the first start, hashes of the anchor and of the piece. ends: for each byte, where its
    text ends."""
    n = len(data) - length + 1
    h = gram_hashes(_byte_codes(5)[data], gram, 3)
    low = (h & ~_U(_LOW)) | np.arange(len(h), dtype=np.uint64)  # of equal hashes the first
    span, width = length - gram + 1, 1
    while 2 * width <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    low = np.minimum(low[:n], low[span - width : span - width + n])
    whole = np.arange(length, length + n) <= ends[:n]
    new = whole.copy()
    new[1:] &= (low[1:] != low[:-1]) | ~whole[:-1]
    start = np.flatnonzero(new)
    stop = whole.copy()
    stop[:-1] &= (low[1:] != low[:-1]) | ~whole[1:]
    last = np.flatnonzero(stop)
    at = (low[start] & _U(_LOW)).astype(np.int64)
    return start, last - start + 1, at - start, h[at], _Prefix(data, 7).of(start, last + length)


def _combined(parts: list[tuple[np.ndarray, ...]], length: int) -> Iterator[pa.RecordBatch]:
    """Rows of ENTRY for (key, piece, doc_id, row, start, windows, lead) of whole documents: of equal pieces of a key only the
    smallest document's first of each row stay, with upto -1; the ranges of the others, from place to upto, are dealt by their row."""
    key, piece, doc, row, start, windows, lead = (np.concatenate(c) for c in zip(*parts, strict=True))
    if not len(key):
        return
    order = np.lexsort((start, row, doc, piece, key))
    key, piece, doc, row, start, windows, lead = (c[order] for c in (key, piece, doc, row, start, windows, lead))
    head = np.concatenate([[True], (key[1:] != key[:-1]) | (piece[1:] != piece[:-1])])
    first = doc[np.maximum.accumulate(np.where(head, np.arange(len(key)), 0))]
    again = ~head
    again[1:] &= (row[1:] == row[:-1]) & (doc[1:] == doc[:-1]) & (start[1:] != start[:-1])
    # a repeated row's pieces are equal to the first one's, start by start: they stay, and are told apart no further
    sure = (doc > first) | again
    kept, place = ~sure, start << 24 | lead << 12 | windows
    yield pa.RecordBatch.from_arrays([pa.array(c) for c in (key[kept].view(np.int64), piece[kept].view(np.int64), doc[kept], row[kept], place[kept], np.full(int(kept.sum()), -1))], NAMES)
    if sure.any():
        d, r, a = doc[sure], row[sure], start[sure]
        z = a + windows[sure] + length - 1
        order = np.lexsort((z, a, r, d))
        d, r, a, z = d[order], r[order], a[order], z[order]
        # neighbouring ranges of a document become one
        new = np.concatenate([[True], (d[1:] != d[:-1]) | (r[1:] != r[:-1]) | (a[1:] > z[:-1])])
        at = np.flatnonzero(new)
        n = len(at)
        yield pa.RecordBatch.from_arrays([pa.array(r[at]), pa.array(r[at]), pa.array(d[at]), pa.array(r[at]), pa.array(a[at]), pa.array(np.maximum.reduceat(z, at))], NAMES)


ENTRY = "key long, piece long, doc_id long, row long, place long, upto long"
NAMES = [x.split()[0] for x in ENTRY.split(", ")]


def _alone(found: tuple[np.ndarray, ...], data: np.ndarray, hot: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """``_pieces`` of which those with a hot anchor are taken apart into single windows, their own anchors."""
    start, windows, lead, key, piece = found
    these = hot[np.minimum(np.searchsorted(hot, key), len(hot) - 1)] == key
    if not these.any():
        return found
    n = windows[these]
    own = np.repeat(start[these], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    one, two = (_Prefix(data, seed).of(own, own + length) for seed in (21, 22))
    more = (own, np.ones(len(own), np.int64), np.full(len(own), ALONE), one, two)
    return tuple(np.concatenate([a[~these], b]) for a, b in zip(found, more, strict=True))


def _anchored(docs: DataFrame, length: int, gram: int, hot: list[int]) -> DataFrame:
    """ENTRY rows of all pieces of docs (doc_id, row, text); hot: anchors whose windows are dealt alone."""
    few = np.sort(np.array(hot, dtype=np.int64).view(np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            held, size = [], 0
            for lo, hi, data, offsets in blocks(batch.column(2), CHUNK):
                size += len(data)
                sizes = np.diff(offsets)
                owner, ends = np.repeat(np.arange(lo, hi), sizes), np.repeat(offsets[1:], sizes)
                for at in range(0, max(0, len(data) - length + 1), CHUNK - length + 1):  # a long text is worked on part by part
                    part = data[at : at + CHUNK]
                    start, windows, lead, key, piece = found = _pieces(part, ends[at : at + CHUNK] - at, length, gram)
                    if len(few):
                        start, windows, lead, key, piece = _alone(found, part, few, length)
                    doc = owner[start + at]
                    held.append((key, piece, ids[doc], rows[doc], start + at - offsets[doc - lo], windows, lead))
                if size >= COMBINED and held:
                    yield from _combined(held, length)
                    held, size = [], 0
            if held:
                yield from _combined(held, length)

    return docs.select("doc_id", "row", "text").mapInArrow(run, ENTRY)


FOUND = "key long, doc_id long, row long, start long, upto long, compare boolean"
PLACES = [x.split()[0] for x in FOUND.split(", ")]


def _settled(entries: DataFrame, length: int) -> DataFrame:
    """FOUND rows from ENTRY rows sorted by key, piece and document: ranges that a smaller document's equal piece shows to be
    repeats, and with ``compare`` the different pieces of a key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def work(table: pa.Table, first: np.ndarray) -> Iterator[pa.RecordBatch]:
            key, piece, doc, row, place, upto = (table.column(c).to_numpy() for c in NAMES)
            sure = upto >= 0
            head = np.zeros(len(key), dtype=bool)
            head[first] = True
            head[1:] |= (piece[1:] != piece[:-1]) | sure[1:] | sure[:-1]
            later = ~sure & (doc > doc[np.maximum.accumulate(np.where(head, np.arange(len(key)), 0))])
            rest = ~sure & ~later
            rest[1:] &= head[1:] | (doc[1:] != doc[:-1]) | (row[1:] != row[:-1]) | (place[1:] != place[:-1])  # equal rows once
            group = np.cumsum(np.isin(np.arange(len(key)), first)) - 1
            rest &= (np.bincount(group[rest], minlength=len(first))[group] > 1) & (place >> 12 & 4095 != ALONE)
            start = np.where(sure, place, place >> 24)
            end = np.where(sure, upto, start + (place & 4095) + length - 1)
            out = sure | later | rest
            yield pa.RecordBatch.from_arrays([pa.array(c[out]) for c in (key, doc, row, start, end, rest)], PLACES)

        return by_runs(batches, 1, work)

    return entries.select(*NAMES).mapInArrow(run, FOUND)


def _texts_of(found: DataFrame) -> DataFrame:
    """(key, doc_id, row, start, text): the bytes of pieces ``want`` (key, start, upto) of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                doc, row, text, want = (c[k].as_py() for c in batch.columns)
                raw, out = (text or "").encode(), sorted((x["key"], x["start"], x["upto"]) for x in want)
                cols = [pa.array([x[0] for x in out], pa.int64()), pa.array([doc] * len(out), pa.int64()), pa.array([row] * len(out), pa.int64()), pa.array([x[1] for x in out], pa.int64())]
                yield pa.RecordBatch.from_arrays([*cols, pa.array([raw[a:z] for _, a, z in out], pa.binary())], ["key", "doc_id", "row", "start", "text"])

    return found.select("doc_id", "row", "text", "want").mapInArrow(run, "key long, doc_id long, row long, start long, text binary")


def repeated(texts: list[bytes], doc: np.ndarray, row: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, from, to): the ranges of documents that windows of the texts cover which start earlier too: in a smaller doc, or
    in the same row further to the front. start: where each text begins in its document."""
    sizes = np.array([len(t) for t in texts])
    shards, owners, cuts = [], [], [0]
    while cuts[-1] < len(texts):
        upto = int(np.searchsorted(np.cumsum(sizes[cuts[-1] :]), PER_SHARD)) + 1
        cuts.append(min(len(texts), cuts[-1] + upto))
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        shards.append(bwt.Shard(np.frombuffer(b"".join(texts[lo:hi]), np.uint8), length))
        owners.append(np.repeat(np.arange(lo, hi), sizes[lo:hi]))
    number, owner = np.concatenate(bwt.classes(shards, length)), np.concatenate(owners)
    place = np.arange(len(owner)) - (np.cumsum(sizes) - sizes)[owner]
    use = place + length <= sizes[owner]
    use &= np.bincount(number[use], minlength=int(number.max()) + 1)[number] > 1
    number, owner, place = number[use], owner[use], place[use]
    at = start[owner] + place
    order = np.lexsort((at, row[owner], doc[owner], number))
    number, owner, at = number[order], owner[order], at[order]
    head = np.concatenate([[True], number[1:] != number[:-1]])[: len(number)]
    mine = head.copy()
    mine[1:] |= (doc[owner[1:]] != doc[owner[:-1]]) | (row[owner[1:]] != row[owner[:-1]])
    lead, own = (np.maximum.accumulate(np.where(x, np.arange(len(x)), 0)) for x in (head, mine))
    gone = (doc[owner] > doc[owner[lead]]) | (at > at[own])
    owner, at = owner[gone], at[gone]
    order = np.lexsort((at, owner))
    owner, at = owner[order], at[order]
    new = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (at[1:] != at[:-1] + 1)])[: len(at)])
    last = np.append(new[1:], len(at)) - 1 if len(new) else new
    return owner[new], at[new], at[last] + length


def _merged(pieces: DataFrame, length: int) -> DataFrame:
    """(doc_id, row, start, upto): repeated ranges, from pieces sorted by key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def work(table: pa.Table, first: np.ndarray) -> Iterator[pa.RecordBatch]:
            doc, row, start = (table.column(c).to_numpy() for c in ("doc_id", "row", "start"))
            owner, a, z = repeated(table.column("text").to_pylist(), doc, row, start, length)
            yield pa.RecordBatch.from_arrays([pa.array(doc[owner]), pa.array(row[owner]), pa.array(a), pa.array(z)], ["doc_id", "row", "start", "upto"])

        return by_runs(batches, 1, work, TOGETHER)

    return pieces.select("key", "doc_id", "row", "start", "text").mapInArrow(run, "doc_id long, row long, start long, upto long")


def _kept(batches: Iterator[pa.RecordBatch], bytes_out: bool) -> Iterator[pa.RecordBatch]:
    """Rows of doc_id, text and ranges (start, upto) without what the ranges cover."""
    for batch in batches:
        n_bytes, n_removed, n_spans, digests, kept = [], [], [], [], []
        for k in range(batch.num_rows):
            raw = (batch.column(1)[k].as_py() or "").encode()
            parts, at, gone, spans = [], 0, 0, 0
            for a, z in sorted((x["start"], x["upto"]) for x in batch.column(2)[k].as_py() or ()):
                if a > at or not spans:
                    parts.append(raw[at:a])
                    spans, gone, at = spans + 1, gone + z - a, z
                elif z > at:
                    gone, at = gone + z - at, z
            rest = b"".join([*parts, raw[at:]])
            n_bytes.append(len(raw))
            n_removed.append(gone)
            n_spans.append(spans)
            digests.append(hashlib.sha256(rest).hexdigest())
            kept.append(rest if bytes_out else None)
        cols = [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(digests, pa.string())]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        yield pa.RecordBatch.from_arrays(cols + [pa.array(kept, pa.binary())] * bytes_out, names + ["kept"] * bytes_out)


def _hot_anchors(docs: DataFrame, length: int, gram: int, part: int, hot: int) -> list[int]:
    """Anchors that have ``hot`` or more different pieces in one of ``part`` of the documents, at most MOST."""
    some = _anchored(docs.where(F.pmod("row", F.lit(part)) == 0), length, gram, []).where("upto < 0")
    many = some.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= hot)
    return [r["key"] for r in many.orderBy(F.desc("n"), "key").limit(MOST).collect()]


def repeated_ranges(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, part: int = PART, hot: int = HOT) -> DataFrame:
    """(doc_id, row, start, upto): ranges of bytes of docs (doc_id, row, text) that repeated windows cover; they may overlap."""
    spark = docs.sparkSession
    entries = _anchored(docs, length, gram, _hot_anchors(docs, length, gram, part, hot))
    parts = _scratch.parts_for(spark, _scratch.size_of(docs), PER_TASK)
    found = _scratch.written(_settled(entries.repartition(parts, "key").sortWithinPartitions("key", "piece", "doc_id", "row", "place"), length), "pieces")
    _scratch.release(spark)
    wanted = found.where("compare").groupBy("doc_id", "row").agg(F.collect_list(F.struct("key", "start", "upto")).alias("want"))  # as many as a text has at most
    pieces = _texts_of(docs.dropDuplicates(["doc_id", "row"]).join(wanted, ["doc_id", "row"]))
    merged = _scratch.written(_merged(pieces.repartition(parts, "key").sortWithinPartitions("key"), length), "merged")
    _scratch.release(spark)
    return found.where("not compare").select("doc_id", "row", "start", "upto").unionAll(merged)


def remove_repeats(docs: DataFrame, length: int = LENGTH, bytes_out: bool = False, gram: int | None = None, part: int = PART, hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]) of every document, its text as UTF-8 bytes.

    A byte goes if a string of ``length`` bytes that covers it also starts earlier: in a document of smaller doc_id, or in the
    same document further to the front; strings overlap, lie within one document and are judged on the input. n_spans: the
    maximal runs of removed bytes; kept: the other bytes, concatenated, which may begin within a character. A null or empty
    text has no bytes; one shorter than length loses nothing; rows of one doc_id, of equal or of different texts, don't repeat each
    other and are each judged by their own text; rows of a null doc_id are kept whole and no repeats are looked for in them; an
    empty table gives no rows; other columns are not read.

    gram: bytes of an anchor, up to length. part, hot: anchors with hot or more different pieces in one of part of the documents
    have their windows dealt one by one.
    """
    gram = gram or min(GRAM, max(1, length * 2 // 5))
    if not 1 <= gram <= length < 2048:
        raise ValueError("length must be from 1 to 2047, gram from 1 to length")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    own = own.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), "text")
    found = repeated_ranges(own.where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= length)), length, gram, part, hot)
    found = found.groupBy("doc_id", "row").agg(F.collect_set(F.struct("start", "upto")).alias("ranges"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * bytes_out
    return own.join(found, ["doc_id", "row"], "left").select("doc_id", "text", "ranges").mapInArrow(lambda b: _kept(b, bytes_out), schema)
