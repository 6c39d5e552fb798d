"""Language identification: averaged hashed subword embeddings under a linear softmax (operator 2)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.llm._text import blocks

#: Hash buckets and dimensions of the embeddings; lengths in bytes of the subwords.
BUCKETS, DIM, GRAMS = 1 << 15, 16, (3, 4)
#: At most so many labelled documents are drawn for training, spread evenly over the languages.
SAMPLE = 2400
UNDETERMINED = "und"

#: Letters as they are, A-Z lower-cased, any other ASCII byte as a space.
_FOLD = np.full(256, 32, dtype=np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def subwords(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(buckets, first of each document and the total) of all subwords of each length: runs of bytes whose inner ones are
    letters, so that a space stands for a word's border."""
    n = len(offsets) - 1
    text = np.insert(_FOLD[data], offsets, 32)
    start = offsets + np.arange(n + 1)
    letter = text != 32
    wide = text.astype(np.uint32)
    for k in GRAMS:
        m = len(text) - k + 1
        if m <= 0:
            yield np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
            continue
        code, good = wide[:m].copy(), np.ones(m, dtype=bool)
        for j in range(1, k):
            code |= wide[j : j + m] << np.uint32(8 * j)
            if j < k - 1:
                good &= letter[j : j + m]
        at = np.flatnonzero(good)
        code = (code[at] ^ np.uint32(k * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
        code ^= code >> np.uint32(13)
        code *= np.uint32(0xC2B2AE35)
        yield (code >> np.uint32(17)).astype(np.int64), np.searchsorted(at, start)


@dataclass
class Model:
    """languages and, for each bucket, its embedding's share of every language's logit; with more languages than DIM the
    embedding itself, and head, which turns the mean of these into logits. temperature and floor are the calibration:
    probabilities are those of logits / temperature, and below floor a prediction is not accepted."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    floor: float = 0.0
    head: np.ndarray | None = None

    def logits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        total, count = np.zeros((n, self.table.shape[1]), dtype=np.float64), np.zeros(n)
        for bucket, first in subwords(data, offsets):
            size = np.diff(first)
            some = np.flatnonzero(size)
            if len(some):
                total[some] += np.add.reduceat(self.table[bucket], first[:-1][some], axis=0, dtype=np.float64)
                count[some] += size[some]
        mean = total / np.maximum(count, 1)[:, None]
        return (mean if self.head is None else mean @ self.head) + self.bias

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.temperature
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def _bags(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(distinct buckets, their shares) of each text."""
    out = []
    for _, _, data, offsets in blocks(pa.array(texts, pa.large_string())):
        parts = list(subwords(data, offsets))
        for i in range(len(offsets) - 1):
            own = np.concatenate([b[f[i] : f[i + 1]] for b, f in parts])
            bucket, count = np.unique(own, return_counts=True)
            out.append((bucket, count / max(1, len(own))))
    return out


def fit(texts: list[str], langs: list[str], epochs: int = 6, rate: float = 4.0, seed: int = 3) -> Model:
    """Trains by stochastic gradient descent in numpy. Every fifth text calibrates instead: the temperature of least log
    loss, and the floor below which at most one in a hundred right predictions lies. Each training text also gives a
    passage of a few words, so that short texts are learned as well."""
    names = sorted(set(langs))
    y = np.array([names.index(x) for x in langs], dtype=np.int64)
    test = np.arange(len(texts)) % 5 == 4
    if not test.any() or len(names) < 2:
        test[:] = False
    whole = [t for t, out in zip(texts, test, strict=True) if not out]
    label = y[~test]
    rng = np.random.default_rng(seed)

    def passage(t: str) -> str:
        w = t.split()
        at = int(rng.integers(0, max(1, len(w) - 8)))
        return " ".join(w[at : at + int(rng.integers(2, 9))])

    bags = _bags(whole + [passage(t) for t in whole])
    label = np.concatenate([label, label])
    weight = 1 / np.bincount(label, minlength=len(names)).clip(1)[label]
    weight /= weight.mean()
    e = rng.uniform(-1, 1, (BUCKETS, DIM)) / DIM
    w, b = np.zeros((DIM, len(names))), np.zeros(len(names))
    steps, done = epochs * (-(-len(bags) // 16)), 0
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for lo in range(0, len(order), 16):
            some = [i for i in order[lo : lo + 16] if len(bags[i][0])]
            if not some:
                continue
            now = rate * (1 - done / steps)
            done += 1
            bucket = np.concatenate([bags[i][0] for i in some])
            share = np.concatenate([bags[i][1] for i in some])
            size = np.array([len(bags[i][0]) for i in some])
            first = np.cumsum(size) - size
            x = np.add.reduceat(e[bucket] * share[:, None], first, axis=0)
            z = x @ w + b
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(some)), label[some]] -= 1
            p *= weight[some, None] / len(some)
            back = p @ w.T
            w -= now * (x.T @ p)
            b -= now * 0.1 * p.sum(axis=0)
            np.add.at(e, bucket, -now * 16 * share[:, None] * np.repeat(back, size, axis=0))
    model = Model(names, (e @ w).astype(np.float32), b) if len(names) <= DIM else Model(names, e.astype(np.float32), b, head=w)
    if test.any():
        held = [t for t, out in zip(texts, test, strict=True) if out]
        logits = np.concatenate([model.logits(d, o) for _, _, d, o in blocks(pa.array(held, pa.large_string()))])
        truth = y[test]

        def loss(t: float) -> float:
            model.temperature = t
            return -np.log(model.probabilities(logits)[np.arange(len(truth)), truth].clip(1e-12)).mean()

        model.temperature = min(np.geomspace(0.05, 8, 40), key=loss)
        p = model.probabilities(logits)
        right = p.argmax(axis=1) == truth
        model.floor = float(np.quantile(p.max(axis=1)[right], 0.01)) if right.any() else 0.0
    return model


def held_out(doc_id):
    """Whether a document is kept from training: crc32 of its id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def quotas(counts: dict[str, int], sample: int) -> dict[str, int]:
    """How many documents of each language are learned from: as even as the counts allow, what a rare language leaves going
    to the others, ``sample`` in all. Every language has one at least, so more than ``sample`` languages get one each."""
    out, left = {}, sample
    for k, (lang, n) in enumerate(sorted(counts.items(), key=lambda x: (x[1], x[0]))):
        out[lang] = min(n, max(1, left // (len(counts) - k)))
        left -= out[lang]
    return out


def train(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    """A model from at most ``sample`` labelled documents that are not held out (one of each language where there are more
    languages), whole, those of the least hashes of their ids in each language, as evenly as the counts allow: every
    language with a labelled document is learned. None where no document has a language."""
    known = docs.where("lang is not null and text is not null and doc_id is not null").where(~held_out(F.col("doc_id")))
    known = known.select(F.col("lang").cast("string").alias("lang"), "doc_id", "text")
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    quota = quotas(counts, sample)
    # about twice the quota, and 20 more, of each language by hash; of these the least hashes
    rates = known.sparkSession.createDataFrame([(k, q, min(1.0, (2 * q + 20) / counts[k])) for k, q in quota.items()], "lang string, quota long, rate double")
    chance = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / float(1 << 40)
    some = known.join(F.broadcast(rates), "lang").withColumn("c", chance).where("c < rate")
    place = F.row_number().over(Window.partitionBy("lang").orderBy("c", "doc_id", "text"))
    rows = some.withColumn("place", place).where("place <= quota").orderBy("c", "lang", "text").select("lang", "text").collect()
    # a language whose documents all have the same few ids may have no hash below its rate
    missing = sorted(set(counts) - {r["lang"] for r in rows})
    if missing:
        rows += known.where(F.col("lang").isin(missing)).groupBy("lang").agg(F.min("text").alias("text")).orderBy("lang").collect()
    return fit([r["text"] for r in rows], [r["lang"] for r in rows])


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, lang_pred, score, accepted) of every document by its whole text alone.

    lang_pred is the likeliest learned language, UNDETERMINED for a null text, one without a letter, or without a model;
    score its calibrated probability (0 if undetermined). accepted is false where that is below the model's floor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score = [], []
            letters = batch.column(2).to_pylist()
            for lo, hi, data, offsets in blocks(batch.column(1)):
                p = model.probabilities(model.logits(data, offsets)) if model else np.zeros((hi - lo, 1))
                best = p.argmax(axis=1)
                for k in range(hi - lo):
                    some = bool(letters[lo + k]) and model is not None
                    lang.append(model.languages[best[k]] if some else UNDETERMINED)
                    score.append(float(p[k, best[k]]) if some else 0.0)
            ok = [x != UNDETERMINED and s >= model.floor for x, s in zip(lang, score, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(ok, pa.bool_())], ["doc_id", "lang_pred", "score", "accepted"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    own = own.withColumn("letter", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    return own.mapInArrow(run, "doc_id long, lang_pred string, score double, accepted boolean")
