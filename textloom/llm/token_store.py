"""Token ids in a binary file format: frequency ranks in byte-aligned variable-length coding (operator 4).

A store is a folder of Parquet files (Spark's commit protocol makes a rewritten task's files safe) whose rows are blocks
of whole documents in ascending doc_id order: ``part`` and ``block`` give their order, ``docs`` and ``sizes`` the
documents' ids and numbers of token ids, ``control`` and ``data`` the coded ids. A token id is replaced by its frequency
rank over the whole corpus. Four ranks share a control byte, two bits each, lowest first: the number of bytes, less one,
of the rank in ``data``, little-endian. ``ranks`` beside the blocks lists the ids by rank.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.llm import _scratch
from textloom.llm._text import blocks
from textloom.llm.tokens import UnitEncoder, with_end

#: By control byte: the bytes of its four values.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of uint32 values."""
    v = np.ascontiguousarray(values, dtype="<u4")
    most = int(v.max(initial=0))
    size = np.zeros(-(-len(v) // 4) * 4, dtype=np.uint8)  # bytes beyond the first
    wide = 1
    while most >> 8 * wide:
        size[: len(v)] += v >= 1 << 8 * wide
        wide += 1
    control = size[::4] | size[1::4] << 2 | size[2::4] << 4 | size[3::4] << 6
    mine = np.arange(wide, dtype=np.uint8) <= size[: len(v), None]
    return control.tobytes(), v.view(np.uint8).reshape(-1, 4)[:, :wide][mine].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n values of pack(): every control byte's lengths come from a table, places from their running sum."""
    size = LENGTHS[np.frombuffer(control, dtype=np.uint8)].ravel()[:n]
    at = np.cumsum(size) - size
    raw = np.frombuffer(data, dtype=np.uint8)
    out = raw[at].astype(np.uint32)
    for k in range(1, int(size.max(initial=1))):
        longer = np.flatnonzero(size > k)
        out[longer] |= raw[at[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def _list(values: np.ndarray | pa.Array) -> pa.Array:
    """One row that lists the values."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values) if isinstance(values, np.ndarray) else values)


def _tokenized(docs: DataFrame, path: str, kind: str, end: int) -> DataFrame:
    """(part, block, docs, sizes, ids): token ids of blocks of documents, ids as little-endian uint16 bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, block = UnitEncoder.of(path, kind), 0  # a task has one part
        for batch in batches:
            for lo, hi, data, offsets in blocks(batch.column(2)):
                ids, offsets = with_end(*encoder.encode_block(data, offsets), end)
                counts = np.bincount(ids)
                seen = np.flatnonzero(counts)
                cols = [batch.column(0).slice(lo, 1), pa.array([block], pa.int64()), _list(batch.column(1).slice(lo, hi - lo)), _list(np.diff(offsets)), pa.array([ids.astype("<u2").tobytes()], pa.binary()), _list(seen.astype(np.int32)), _list(counts[seen])]
                yield pa.RecordBatch.from_arrays(cols, ["part", "block", "docs", "sizes", "ids", "seen", "counts"])
                block += 1

    schema = "part int, block long, docs array<long>, sizes array<long>, ids binary, seen array<int>, counts array<long>"
    return docs.mapInArrow(run, schema)


def in_ranges(docs: DataFrame, descending: bool = False, per_part: int = 32 << 20) -> DataFrame:
    """(part, doc_id, text) dealt to ranges of doc_id and sorted within them, ascending with null ids first or descending
    with null ids last; a null text is empty. Rows of one id go in any order, so that many of them are many ranges."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    parts = _scratch.parts_for(spark, _scratch.size_of(docs), per_part)
    order = [F.col("doc_id").desc_nulls_last() if descending else F.col("doc_id").asc_nulls_first(), F.col("tie")]
    return docs.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(parts, *order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("part"), "doc_id", "text")


def write(docs: DataFrame, to: str, path: str, kind: str = "byte", end: int = 2) -> None:
    """Writes the store of docs at ``to``. path: the vocabulary's file. Every text is tokenized once; the ids wait as
    plain uint16 in a scratch table until the frequencies over all documents are known."""
    spark = docs.sparkSession
    plain = _scratch.new_path(spark, "plain-ids")
    _tokenized(in_ranges(docs), path, kind, end).write.option("compression", "zstd").parquet(plain)
    _scratch.release(spark)
    schema = "part int, block long, docs array<long>, sizes array<long>, ids binary, seen array<int>, counts array<long>"
    table = spark.read.schema(schema).parquet(plain)
    counts = table.select(F.explode(F.arrays_zip("seen", "counts")).alias("x")).groupBy("x.seen").agg(F.sum("x.counts").alias("n"))
    # one row for each id of the vocabulary, under 65,536
    order = [r["seen"] for r in counts.orderBy(F.col("n").desc(), "seen").collect()]
    rank = np.zeros(1 << 16, dtype=np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids = np.frombuffer(batch.column(4)[i].as_buffer(), dtype="<u2")
                control, data = pack(rank[ids])
                one = batch.slice(i, 1)
                yield pa.RecordBatch.from_arrays([*one.columns[:4], pa.array([len(ids)], pa.int64()), pa.array([control], pa.binary()), pa.array([data], pa.binary())], ["part", "block", "docs", "sizes", "n", "control", "data"])

    coded = table.select("part", "block", "docs", "sizes", "ids").mapInArrow(run, "part int, block long, docs array<long>, sizes array<long>, n long, control binary, data binary")
    coded.write.option("compression", "none").parquet(f"{to}/blocks")
    _scratch.drop(spark, plain)
    spark.createDataFrame([(order,)], "ids array<int>").coalesce(1).write.parquet(f"{to}/ranks")


def read(spark: SparkSession, at: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document of a store, decoded from its files. start counts the ids of
    all documents before it: by a running sum over the blocks' totals, which are two rows for each MB of text."""
    blocks = spark.read.schema("part int, block long, docs array<long>, sizes array<long>, n long, control binary, data binary").parquet(f"{at}/blocks")
    ids = np.array(spark.read.schema("ids array<int>").parquet(f"{at}/ranks").first()["ids"], dtype="<u4")
    parts = blocks.groupBy("part").agg(F.sum("n").alias("n"))
    # one row for each range of ids
    total = parts.select("part", (F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("part")) - F.col("n")).alias("base"))
    own = blocks.select("part", "block", "n")
    starts = own.join(total, "part").select("part", "block", (F.col("base") + F.sum("n").over(Window.partitionBy("part").orderBy("block")) - F.col("n")).alias("start"))
    starts = _scratch.written(starts, "block-starts")
    small = starts.count() <= 1_000_000

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                start, n, control, data = (batch.column(k)[i].as_py() for k in range(2, 6))
                raw, sizes = memoryview(ids[unpack(control, data, n)].tobytes()), batch.column(1).slice(i, 1).flatten()
                edge = np.concatenate([[0], np.cumsum(sizes.to_numpy())])
                crc = [zlib.crc32(raw[a:b]) for a, b in zip((4 * edge[:-1]).tolist(), (4 * edge[1:]).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1).flatten(), pa.array(edge[:-1] + start), sizes, pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    with_start = blocks.join(F.broadcast(starts) if small else starts, ["part", "block"]).select("docs", "sizes", "start", "n", "control", "data")
    return with_start.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def store_documents(docs: DataFrame, path: str, kind: str = "byte", end: int = 2) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from a store written to the shared folder and read back.

    A null or empty text has the end id alone; rows of a null doc_id come first; repeated doc_ids follow each other; an
    empty table gives no rows. Texts are tokenized whole, in blocks of about half a MB of whole documents.
    """
    at = _scratch.new_path(docs.sparkSession, "token-store")
    write(docs, at, path, kind, end)
    return read(docs.sparkSession, at)
