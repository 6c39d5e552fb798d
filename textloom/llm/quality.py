"""Quality classifier by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k (operator 6)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import _scratch
from textloom.llm._text import SPACE, blocks, mix, powers, words

#: Buckets of hashed words and of hashed pairs of word shapes; pseudo-counts of a bucket.
WORDS, SHAPES, PRIOR = 1 << 17, 1 << 12, 4.0
#: At most so many labelled documents are used: half of them for the target model, half to calibrate.
SAMPLE = 20_000
#: Words count as evidence on their own if at least so many rejected documents of the sample have them, and their log
#: ratio of good to rejected documents is below this.
STRONG_DOCS, STRONG = 3, -1.5

_CLASS = np.zeros(256, dtype=np.uint8)  # 0 control, 1 lower, 2 upper, 3 digit, 4 punctuation of prose, 5 symbol
_CLASS[33:127] = 5
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 1, 2, 3
_CLASS[[ord(c) for c in ".,;:'\"?()-"]] = 4
_CLASS[128:] = 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = mix(np.arange(1, 257, dtype=np.uint64))[_LOWER]
_LETTER[(_CLASS != 1) & (_CLASS != 2)] = 0
_BASE = 0x9E3779B97F4A7C15


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word bucket, shape bucket, first word of each document and the total).

    A word's bucket hashes its letters, A-Z lower-cased. Its shape is the kinds of its first and last character, whether
    it has two or more capitals and whether it repeats the word before; the shape bucket hashes a word's shape with that
    of the word before it in its document.
    """
    starts, ends, first = words(data, offsets)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), first
    kind = _CLASS[data]
    letter = (kind == 1) | (kind == 2)
    p, q = powers(_BASE, len(data) + 1)
    index = np.concatenate([[0], np.cumsum(letter)])
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_LETTER[data] * p[index[:-1]], out=sums[1:])
    word = mix((sums[ends] - sums[starts]) * q[index[starts]])
    capitals = np.concatenate([[0], np.cumsum(kind == 2)])
    shape = kind[starts].astype(np.int64) * 6 + kind[ends - 1]
    shape = shape * 2 + (capitals[ends] - capitals[starts] > 1)
    again = np.concatenate([[False], word[1:] == word[:-1]])
    head = first[:-1][first[:-1] < first[1:]]
    again[head] = False
    shape = shape * 2 + again
    before = np.concatenate([[0], shape[:-1] + 1])
    before[head] = 0
    pair = mix((before * 1000 + shape).astype(np.uint64) + np.uint64(1)) >> np.uint64(52)
    return (word >> np.uint64(47)).astype(np.int64), pair.astype(np.int64), first


@dataclass
class Model:
    """Log ratios of target to raw by bucket, the strong evidence of words against a document, and the calibrated least
    mean and least sum of evidence of what stays. A text is allowed ``allowance`` of evidence a word, as what chance
    brings grows with its length."""

    words: np.ndarray
    shapes: np.ndarray
    evidence: np.ndarray
    least_mean: float = -np.inf
    least_strong: float = -np.inf
    allowance: float = 0.0

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(mean log ratio of a document's words and shapes, sum of its words' strong evidence, number of words)."""
        word, shape, first = features(data, offsets)
        n = len(offsets) - 1
        mean, strong = np.zeros(n), np.zeros(n)
        size = np.diff(first)
        some = np.flatnonzero(size)
        if len(some):
            at = first[:-1][some]
            mean[some] = np.add.reduceat(self.words[word] + self.shapes[shape], at, dtype=np.float64) / size[some]
            strong[some] = np.add.reduceat(self.evidence[word], at, dtype=np.float64)
        return mean, strong, size

    def keeps(self, mean: np.ndarray, strong: np.ndarray, size: np.ndarray) -> np.ndarray:
        return (mean >= self.least_mean) & (strong + self.allowance * size >= self.least_strong)


def _counts(docs: DataFrame) -> DataFrame:
    """(bucket, raw, target, good, bad): n-grams of all documents and of the target's sample; documents of the good and
    the rejected sample that have a word. docs: (text, role), role 1 good, 3 rejected, else not of the sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = WORDS + SHAPES
        total = np.zeros((4, size), dtype=np.int64)
        for batch in batches:
            role = np.array(batch.column(1).to_pylist())
            for lo, hi, data, offsets in blocks(batch.column(0)):
                word, shape, first = features(data, offsets)
                total[0] += np.bincount(word, minlength=size) + np.bincount(shape + WORDS, minlength=size)
                for k in np.flatnonzero((role[lo:hi] == 1) | (role[lo:hi] == 3)):
                    own, form = word[first[k] : first[k + 1]], shape[first[k] : first[k + 1]]
                    if role[lo + k] == 1:
                        np.add.at(total[1], own, 1)
                        np.add.at(total[1], form + WORDS, 1)
                    total[2 if role[lo + k] == 1 else 3][np.unique(own)] += 1
        some = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(some), *[pa.array(t[some]) for t in total]], ["bucket", "raw", "target", "good", "bad"])

    parts = docs.mapInArrow(run, "bucket long, raw long, target long, good long, bad long")
    return parts.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in ("raw", "target", "good", "bad")])


def train(docs: DataFrame, labels: DataFrame, keep: float = 0.9995) -> Model:
    """The model of good (quality 1, not toxic) against raw text.

    The raw model counts every document. The target model counts good ones of a sample of at most SAMPLE labelled
    documents, chosen by a hash of their ids; three quarters of it. Words of these that good documents hardly have, but
    rejected ones do, are evidence on their own: a few of them in a long text would vanish in its mean. The sample's last
    quarter calibrates, so that a share ``keep`` of its good documents passes each of the two thresholds. Without good labelled documents nothing is rejected. A document
    labelled more than once is good if all its labels say so; labels without a doc_id don't count.
    """
    good = F.min(((F.coalesce("quality", F.lit(0)) == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).cast("int"))
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(good.alias("good"))
    order = F.xxhash64("doc_id", F.lit(6))
    marks = marks.withColumn("h", order).orderBy("h", "doc_id").limit(SAMPLE)
    marks = marks.select("doc_id", "good", F.when(F.pmod("h", F.lit(4)) > 0, F.when(F.col("good") == 1, 1).otherwise(3)).otherwise(2).alias("role"))
    marks = _scratch.written(marks, "quality-sample")
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    marked = text.join(F.broadcast(marks), "doc_id", "left")  # at most SAMPLE rows
    sums = _counts(marked.select("text", F.coalesce("role", F.lit(0)).alias("role"))).collect()  # a row for each bucket
    raw, target, good, bad = np.zeros((4, WORDS + SHAPES))
    for r in sums:
        raw[r["bucket"]], target[r["bucket"]], good[r["bucket"]], bad[r["bucket"]] = r["raw"], r["target"], r["good"], r["bad"]
    sizes = {r["role"]: r["n"] for r in marks.groupBy("role").agg(F.count("*").alias("n")).collect()}

    def ratio(part: slice) -> np.ndarray:
        if not target[part].sum():
            return np.zeros(len(raw[part]))
        expected = raw[part] * (target[part].sum() / raw[part].sum())
        return np.log((target[part] + PRIOR) / (expected + PRIOR))

    odds = np.log((good[:WORDS] + 1) / (sizes.get(1, 0) + 2)) - np.log((bad[:WORDS] + 1) / (sizes.get(3, 0) + 2))
    odds = np.where((odds < STRONG) & (bad[:WORDS] >= STRONG_DOCS), odds, 0.0)
    model = Model(ratio(slice(0, WORDS)), ratio(slice(WORDS, None)), odds)
    model.words[0] = model.evidence[0] = 0  # words without letters
    if not target.any():
        return model
    held = scored(marked.where("role = 2").select("doc_id", "text", "good"), model, ["doc_id", "good"]).where("good = 1").select("mean", "strong", "n_words").collect()
    if held:
        # of n held documents each threshold may reject (1 - keep) n, and lies a margin below the least that stays
        mean, strong, size = (np.array([r[k] for r in held], dtype=np.float64) for k in ("mean", "strong", "n_words"))
        model.allowance = float(-4 * strong.sum() / max(1.0, size.sum()))
        at = int((1 - keep) * len(held))
        model.least_mean, model.least_strong = np.sort(mean)[at] - 0.02, np.sort(strong + model.allowance * size)[at] - 0.5
    return model


def scored(docs: DataFrame, model: Model, columns: list[str]) -> DataFrame:
    """columns, then mean, strong, n_words and accepted, of every row of docs by its whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.scores(data, offsets) for _, _, data, offsets in blocks(batch.column(len(columns)))]
            mean, strong, size = (np.concatenate([f[k] for f in found]) if found else np.zeros(0) for k in range(3))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(mean), pa.array(strong), pa.array(size.astype(np.int64)), pa.array(model.keeps(mean, strong, size))], [*columns, "mean", "strong", "n_words", "accepted"])

    own = docs.select(*columns, F.col("text").cast("string").alias("text"))
    schema = own.select(*columns).schema.add("mean", "double").add("strong", "double").add("n_words", "long").add("accepted", "boolean")
    return own.mapInArrow(run, schema)


def kept(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, whole and with all columns, whose text the model doesn't reject; a null text is empty, and stays."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.keeps(*model.scores(data, offsets)) for _, _, data, offsets in blocks(batch.column(at))]
            if found:
                yield batch.filter(pa.array(np.concatenate(found)))

    return docs.mapInArrow(run, docs.schema)


def resample(scores: DataFrame, k: int, strength: float = 20.0, seed: int = 6) -> DataFrame:
    """scores with log_weight, gumbel_key and selected: k documents drawn without replacement with probabilities in
    proportion to exp(log_weight), by the k largest sums of log_weight and Gumbel noise of a hash of doc_id.

    log_weight is ``strength`` times the length-normalised log ratio: that of a passage of so many words. Rejected
    documents are not drawn. The k-th key is found by counting in ever finer intervals; equal keys go by doc_id.
    """
    u = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    keyed = scores.withColumn("log_weight", F.col("mean") * strength).withColumn("gumbel_key", F.col("log_weight") - F.log(-F.log(u)))
    keyed = _scratch.written(keyed, "gumbel-keys")
    in_play, left = keyed.where("accepted"), k
    low, high = in_play.agg(F.min("gumbel_key"), F.max("gumbel_key")).first()
    if low is None:
        return keyed.withColumn("selected", F.lit(False))
    for _ in range(12):
        width = (high - low) / 1000
        if width <= 0 or low + width == low:
            break
        at = F.least(F.floor((F.col("gumbel_key") - low) / width), F.lit(999)).alias("at")
        n = {r["at"]: r["n"] for r in in_play.groupBy(at).agg(F.count("*").alias("n")).collect()}
        if sum(n.values()) <= max(left, 10_000):
            break
        for b in range(999, -1, -1):
            if n.get(b, 0) >= left or b == 0:
                break
            left -= n.get(b, 0)
        in_play = in_play.where(at == b)
        low, high = in_play.agg(F.min("gumbel_key"), F.max("gumbel_key")).first()
    last = in_play.orderBy(F.col("gumbel_key").desc(), "doc_id").limit(max(left, 0)).select("gumbel_key", "doc_id").orderBy("gumbel_key", F.col("doc_id").desc()).first() if left > 0 else None
    if last is None:
        return keyed.withColumn("selected", F.lit(False))
    over = (F.col("gumbel_key") > last["gumbel_key"]) | ((F.col("gumbel_key") == last["gumbel_key"]) & (F.coalesce("doc_id", F.lit(-(1 << 63))) <= (last["doc_id"] if last["doc_id"] is not None else -(1 << 63))))
    return keyed.withColumn("selected", F.col("accepted") & over)


def classify(docs: DataFrame, labels: DataFrame, share: float = 0.5) -> DataFrame:
    """(doc_id, score, strong, n_words, accepted, log_weight, gumbel_key, selected) of every document.

    score is the mean log ratio, strong the sum of strong evidence against; accepted is the classifier's decision;
    selected is the Gumbel top-k draw of a share of the accepted documents. A text without words scores 0 and is
    accepted; rows of a null doc_id are scored like any; an empty table gives no rows.
    """
    model = train(docs, labels)
    found = scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model, ["doc_id"])
    found = _scratch.written(found, "quality-scores")
    k = int(found.where("accepted").count() * share)
    return resample(found, k).withColumnRenamed("mean", "score")
