"""Vector bin packing of token sequences under several limits at once (operator 9)."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.tokens import UnitEncoder, with_end

#: A sequence's limits: tokens, segments, loss-bearing tokens. Examples that wait in a task's pool.
TOKENS, SEGMENTS, LOSS, POOL = 2048, 128, 2048, 1024


class Packer:
    """Packs examples (tokens, loss-bearing tokens) into sequences under the limits.

    The open sequence takes, again and again, the fitting example of the largest dot product of its needs and the
    sequence's room, both as shares of the limits. When none fits, the largest waiting example is cut to fill it, if
    segments are left. ``place(example, start, length, sequence, offset)`` is called for each piece.
    """

    def __init__(self, place, tokens: int = TOKENS, segments: int = SEGMENTS, loss: int = LOSS):
        self.place, self.limits = place, np.array([tokens, segments, loss], dtype=np.float64)
        self.sequence, self.room, self.offset = 0, self.limits.copy(), 0
        self.left: list[list[int]] = []  # example, start, length, loss-bearing tokens before any cut of its first id

    def _put(self, example: int, start: int, length: int, loss: int) -> None:
        self.place(example, start, length, self.sequence, self.offset)
        self.offset += length
        self.room -= (length, 1, loss)

    def _next(self) -> None:
        if self.offset:
            self.sequence, self.room, self.offset = self.sequence + 1, self.limits.copy(), 0

    def add(self, examples: list[tuple[int, int, int]]) -> None:
        """Packs all examples (number, tokens, loss-bearing tokens); the last sequence stays open."""
        tokens, segments, loss = self.limits
        queue = []
        for number, n, heavy in examples:
            at, share = 0, heavy / n if n else 0
            while n - at >= tokens and heavy <= loss * n / tokens:  # whole sequences of one example
                held = self.sequence, self.room, self.offset
                self.sequence, self.room, self.offset = self._fresh(), self.limits.copy(), 0
                self._put(number, at, int(tokens), int(share * tokens))
                self.sequence, self.room, self.offset = held
                at += int(tokens)
            if n > at:
                queue.append((number, at, n - at, share))
        while queue:
            need = np.array([(n, 1, share * n) for _, _, n, share in queue])
            waiting = np.ones(len(queue), dtype=bool)
            scores = need / self.limits
            while waiting.any():
                fits = waiting & (need <= self.room + 1e-9).all(axis=1)
                if fits.any():
                    k = int(np.argmax(np.where(fits, scores @ (self.room / self.limits), -1)))
                    number, at, n, share = queue[k]
                    self._put(number, at, n, share * n)
                    waiting[k] = False
                    continue
                k = int(np.argmax(np.where(waiting, need[:, 0], -1)))
                number, at, n, share = queue[k]
                cut = int(min(self.room[0], self.room[2] / share if share else self.room[0], n))
                if self.room[1] >= 1 and 0 < cut < n:
                    self._put(number, at, cut, share * cut)
                    queue[k] = (number, at + cut, n - cut, share)
                    need[k] = (n - cut, 1, share * (n - cut))
                    scores[k] = need[k] / self.limits
                self._close()
            queue = []

    def _fresh(self) -> int:
        """A number of a sequence beside the open one."""
        self.beside = getattr(self, "beside", 0) + 1
        return -self.beside

    def _close(self) -> None:
        self._next()


def _powers(length: int) -> list[int]:
    return [1 << b for b in range(length.bit_length() - 1, -1, -1) if length >> b & 1]


def pack_documents(docs: DataFrame, path: str, end: int = 1, tokens: int = TOKENS, segments: int = SEGMENTS, loss: int = LOSS, bearing: str | None = None) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of every piece of every document.

    A document's ids are its whole text's, by the library's vocabulary at ``path``, and ``end`` after them; all but a
    document's first bear loss, or of instruction data the share that the column ``bearing`` says (0 to 1; null: all but
    the first), spread over the document. Every id lies in exactly one piece, and no sequence has more than ``loss``
    loss-bearing tokens, ``segments`` pieces or ``tokens`` ids. Each task packs its own documents from pools of
    POOL, without a shuffle; sequences are full but for a task's last, which is dealt out to sequences of lengths that
    are powers of two, as those need no padding, and sequences that the segments' limit ends. A null or empty text is
    the end id alone; a null doc_id and repeated rows are packed like any; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = UnitEncoder.of(path, "word")
        task = TaskContext.get().partitionId() << 40
        rows: list[tuple] = []
        pool: dict[int, tuple] = {}
        opened: list[tuple] = []  # pieces of the open sequence

        def place(example: int, start: int, length: int, sequence: int, offset: int) -> None:
            doc_id, raw = pool[example]
            row = (doc_id, start, length, zlib.crc32(raw[4 * start : 4 * (start + length)]), len(raw) // 4, sequence, offset)
            if sequence < 0:
                rows.append((*row[:5], task + 2 * -sequence + 1, offset))
                return
            if opened and opened[-1][0][5] != sequence:
                flush()
            opened.append((row, raw))

        def flush() -> None:
            rows.extend((*row[:5], task + 2 * row[5], row[6]) for row, _ in opened)
            opened.clear()

        packer = Packer(place, tokens, segments, loss)

        def done() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            for lo in range(0, batch.num_rows, POOL):
                part = batch.slice(lo, POOL)
                texts = part.column(1).to_pylist()
                pool.clear()
                at = 0
                while at < len(texts):  # encode about 1 MB at once
                    upto, size = at, 0
                    while upto < len(texts) and (upto == at or size < 1 << 20):
                        size += len(texts[upto])
                        upto += 1
                    ids, offsets = with_end(*encoder.encode(texts[at:upto]), end)
                    wide = ids.astype("<u4").tobytes()
                    for k in range(at, upto):
                        pool[k] = (part.column(0)[k].as_py(), wide[4 * offsets[k - at] : 4 * offsets[k - at + 1]])
                    at = upto
                share = [None] * len(pool) if bearing is None else part.column(2).to_pylist()
                packer.add([(k, n, n - 1 if share[k] is None else int(min(max(share[k], 0.0), 1.0) * n)) for k, (_, raw) in pool.items() for n in [len(raw) // 4]])
                if rows:
                    yield done()
        if opened:
            pieces, opened[:] = list(opened), []
            length = sum(row[2] for row, _ in pieces)
            last, at = pieces[0][0][5], 0
            sizes = _powers(length) if length < tokens else [length]
            edges = np.cumsum([0, *sizes]).tolist()
            for row, raw in pieces:  # cut at the edges of the powers of two
                doc_id, start, n, _, total, _, offset = row
                while n:
                    k = next(i for i in range(len(sizes)) if edges[i] <= offset < edges[i + 1])
                    some = min(n, edges[k + 1] - offset)
                    rows.append((doc_id, start, some, zlib.crc32(raw[4 * start : 4 * (start + some)]), total, task + 2 * (last + k), offset - edges[k]))
                    start, n, offset = start + some, n - some, offset + some
        if rows:
            yield done()

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    own = [F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))]
    return docs.select(*own, *([F.nanvl(F.col(bearing).cast("double"), F.lit(None).cast("double"))] if bearing else [])).mapInArrow(run, schema)
