"""Small files by Hadoop's file systems: any path that Spark reads, whole or not there at all."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


def _at(path: str):
    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p, spark


def exists(path: str) -> bool:
    fs, p, _ = _at(path)
    return fs.exists(p)


def put(path: str, data: bytes) -> None:
    """Writes a file beside its place and moves it there."""
    fs, p, spark = _at(path)
    beside = spark._jvm.org.apache.hadoop.fs.Path(path + ".tmp")
    out = fs.create(beside, True)
    try:
        for lo in range(0, len(data), 1 << 20):
            out.write(bytearray(data[lo : lo + (1 << 20)]))
    finally:
        out.close()
    fs.delete(p, False)
    if not fs.rename(beside, p):
        raise OSError(f"cannot replace {path}")


def get(path: str) -> bytes:
    """A file's bytes, for files that the driver can hold."""
    _, _, spark = _at(path)
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()["content"])


@lru_cache(maxsize=1)
def _own() -> str:
    path = tempfile.mkdtemp(prefix="textloom-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name where all executors can write: below spark.checkpoint.dir, or a temporary one where it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or _own()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame, name: str) -> DataFrame:
    """df as a table that is written once. A sum of doubles that is made twice may differ in its last digit, as its terms
    come in the order in which executors send them: a join of two such results by it would lose rows."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def mounted(spark: SparkSession, name: str) -> str | None:
    """A new folder below spark.checkpoint.dir as tasks open it without Spark; None if that is on no mounted file system, or
    unset where executors are not in the driver's process."""
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.master.startswith("local["):
        return None
    fs, p, _ = _at(scratch(spark, name))
    if fs.getUri().getScheme() != "file":
        return None
    fs.mkdirs(p)
    return p.toUri().getPath()


def drop(path: str) -> None:
    """Deletes a folder of ``mounted``."""
    shutil.rmtree(path, ignore_errors=True)
