"""Document fingerprints: one-permutation MinHash with optimal densification and packed b-bit values (operator 3)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.llm import _scratch
from textloom.llm._text import BLOCK, blocks, mix, shingle_sets, text_buffers, word_hashes, words
from textloom.llm.token_store import in_ranges

BINS, BITS, WIDTH = 512, 4, 5
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


#: Rows of a block; full bins up to which a document's empty bins look them up in ``_met``; bins up to which there is such a table.
ROWS, FEW, TABLE = 256, 64, 1024


def _draws(bins: int, attempts: np.ndarray, of: np.ndarray) -> np.ndarray:
    """The bins that the bins ``of`` draw at these attempts."""
    shift = np.uint64(64 - int(bins).bit_length() + 1)
    with np.errstate(over="ignore"):
        return (mix(of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + attempts.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) >> shift).astype(np.int64)


@lru_cache(maxsize=4)
def _met(bins: int) -> np.ndarray:
    """For each bin and each other: the attempt at which the first one's draws meet the other."""
    first, of, at = np.full((bins, bins), np.iinfo(np.int32).max, dtype=np.int32), np.repeat(np.arange(bins), bins), 0
    while first.max() == np.iinfo(np.int32).max:
        attempts = np.tile(np.arange(at + 1, at + bins + 1), bins)
        np.minimum.at(first, (of, _draws(bins, attempts, of)), attempts.astype(np.int32))
        at += bins
    return first


def sketch(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH, bins: int = BINS, bits: int = BITS) -> np.ndarray:
    """(n, bins) uint8: the low ``bits`` bits of each bin's least shingle hash.

    Every shingle is hashed once; its top bits name its bin. An empty bin takes the value of the first full bin that its
    own sequence of random bins meets (optimal densification: each empty bin draws anew, from the bin's number and the
    attempt alone, so equal bins of two documents draw alike).
    """
    n = len(offsets) - 1
    starts, ends, first = words(data, offsets)
    h, doc = shingle_sets(word_hashes(data, starts, ends, 11), first, width, 11)
    shift = np.uint64(64 - int(bins).bit_length() + 1)
    least = np.full(n * bins, _NONE, dtype=np.uint64)
    if len(h):
        at = doc * bins + (h >> shift).astype(np.int64)
        order = np.argsort(at, kind="stable")
        at = at[order]
        head = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        least[at[head]] = np.minimum.reduceat(mix(h[order]), head)
    least = least.reshape(n, bins)
    full = least != _NONE
    value, attempt = least.copy(), 0
    count = full.sum(axis=1)
    few = (count <= FEW) & (bins <= TABLE)
    for k in np.flatnonzero(few):
        own = np.flatnonzero(full[k])
        value[k] = np.where(full[k], least[k], least[k, own[_met(bins)[:, own].argmin(axis=1)]])
    rows, cols = np.nonzero(~(full | few[:, None]))
    while len(rows):
        attempt += 1
        draw = _draws(bins, np.full(len(cols), attempt), cols)
        ok = full[rows, draw]
        value[rows[ok], cols[ok]] = least[rows[ok], draw[ok]]
        rows, cols = rows[~ok], cols[~ok]
    # the bin's number goes into its bits, else one value's chance agreement would count in all bins that copy it
    value = mix(value + np.arange(bins, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return (value & np.uint64((1 << bits) - 1)).astype(np.uint8)


def packed(values: np.ndarray, bits: int = BITS) -> list[str]:
    """Each row's values as packed bits, in hex digits."""
    flat = np.unpackbits(values[:, :, None], axis=2)[:, :, 8 - bits :].reshape(len(values), -1)
    return [row.tobytes().hex() for row in np.packbits(flat, axis=1)]


def unpacked(fingerprint: str, bits: int = BITS) -> np.ndarray:
    flat = np.unpackbits(np.frombuffer(bytes.fromhex(fingerprint), dtype=np.uint8)).reshape(-1, bits)
    return flat @ (1 << np.arange(bits - 1, -1, -1))


def likeness(a: np.ndarray, b: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The estimate of the Jaccard similarity from the share of equal values, corrected for those that agree by chance
    (1 in 2**bits) and held within 0 and 1."""
    chance = 1 / (1 << bits)
    return np.clip(((a == b).mean(axis=-1) - chance) / (1 - chance), 0, 1)


def edited(text: str, after: str) -> str:
    """text with its last floor(n/2) code points replaced by the first as many (or all) of after."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def _sketches(texts: list[str]) -> np.ndarray:
    found = [sketch(data, offsets) for _, _, data, offsets in blocks(pa.array(texts, pa.large_string()))]
    return np.concatenate(found) if found else np.zeros((0, BINS), np.uint8)


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _results(rows: list[tuple[int | None, str, str]]) -> list[pa.Array]:
    """RESULT's columns for rows of doc_id, text and the next document's text."""
    ids, texts, after = (list(x) for x in zip(*rows, strict=True))
    new = [edited(a, b) for a, b in zip(texts, after, strict=True)]
    one, two = _sketches(texts), _sketches(new)
    three = np.empty_like(one)
    same = [i for i in range(len(rows) - 1) if after[i] is texts[i + 1]]
    rest = sorted(set(range(len(rows))) - set(same))
    three[same] = one[np.array(same, dtype=np.int64) + 1]
    three[rest] = _sketches([after[i] for i in rest])
    sha = [hashlib.sha256(t.encode()).hexdigest() for t in new]
    return [pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array(sha), pa.array(packed(one)), pa.array(packed(two)), pa.array(likeness(one, two)), pa.array(likeness(one, three))]


def _paired(pairs: DataFrame) -> DataFrame:
    """RESULT for rows of (doc_id, text, after)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for k in range(batch.num_rows):
                rows.append(tuple(c[k].as_py() for c in batch.columns))
                size += len(rows[-1][1]) + len(rows[-1][2])
                if size >= BLOCK or len(rows) >= ROWS or k == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays(_results(rows), NAMES)
                    rows, size = [], 0

    return pairs.select("doc_id", "text", "after").mapInArrow(run, RESULT)


NAMES = [x.split()[0] for x in RESULT.split(", ")]


def _neighbours(ranges: DataFrame) -> DataFrame:
    """RESULT and ``border`` (null), for every row of the ranges but the last of each; for each range a row of nulls with
    border: its part, its first row's text, its last row's doc_id and text, whose next one begins another range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, top, last, rows, size = None, "", None, [], 0

        def done(border: dict | None = None) -> pa.RecordBatch:
            cols = _results(rows) if rows else [pa.nulls(0, f) for f in KINDS]
            if border:
                cols = [pa.concat_arrays([c.cast(k), pa.nulls(1, k)]) for c, k in zip(cols, KINDS, strict=True)]
            kind = pa.struct([("part", pa.int32()), ("top", pa.string()), ("doc_id", pa.int64()), ("text", pa.string())])
            return pa.RecordBatch.from_arrays([*cols, pa.array([None] * len(rows) + [border] * bool(border), kind)], [*NAMES, "border"])

        for batch in batches:
            for own, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if last and own == part:
                    rows.append((*last, text))
                    size += len(last[1])
                elif last:
                    yield done({"part": part, "top": top, "doc_id": last[0], "text": last[1]})
                    rows, size = [], 0
                if own != part:
                    part, top = own, text
                last = doc_id, text
                if size >= BLOCK or len(rows) >= ROWS:
                    yield done()
                    rows, size = [], 0
        if last:
            yield done({"part": part, "top": top, "doc_id": last[0], "text": last[1]})

    return ranges.mapInArrow(run, f"{RESULT}, border struct<part: int, top: string, doc_id: bigint, text: string>")


KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every document.

    The fingerprint packs the low BITS bits of BINS one-permutation MinHash values of the whole text's 5-word shingles.
    The next document is the one of next smaller doc_id, after the last the first. A null text is empty; texts without
    words share one fingerprint; repeated doc_ids follow each other in any order; with one document it is its own next;
    rows of a null doc_id are outside the order, each next to itself; an empty table gives no rows.

    Documents are dealt to sorted ranges, so a document's next one lies beside it but at a range's end: the ends, one row
    for each range, are paired with the ranges' first texts afterwards.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = _scratch.written(_neighbours(in_ranges(own.where("doc_id is not null"), descending=True)), "fingerprints")
    ends = found.where("border is not null").select("border.*")
    # numbers of ranges only; texts are joined to them
    order = Window.partitionBy(F.lit(0)).orderBy("part")
    follows = ends.select("part", F.coalesce(F.lead("part").over(order), F.first("part").over(order)).alias("next"))
    pairs = ends.join(follows, "part").join(ends.select(F.col("part").alias("next"), F.col("top").alias("after")), "next")
    alone = own.where("doc_id is null").select("doc_id", "text", F.col("text").alias("after"))
    return found.where("border is null").drop("border").unionAll(_paired(pairs)).unionAll(_paired(alone))
