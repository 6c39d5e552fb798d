"""Written intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
from functools import lru_cache

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only where that is unset (tests), a folder of our own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    return (base or _own_dir()).rstrip("/")


@lru_cache(maxsize=1)
def _own_dir() -> str:
    path = tempfile.mkdtemp(prefix="textloom-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage is cut and a lost executor loses nothing."""
    return written_at(df, name)[1]


def written_at(df: DataFrame, name: str) -> tuple[str, DataFrame]:
    """``written`` with its path, for who drops it."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return path, df.sparkSession.read.schema(df.schema).parquet(path)


#: More buckets than Spark allows by default are never asked for.
MOST_BUCKETS = 100_000


def bucketed(df: DataFrame, name: str, keys: list[str], parts: int, placed: bool = False) -> str:
    """The name of a table of df in the shared folder, in ``parts`` buckets by a hash of keys, each sorted by them: joins and
    groups by keys need no exchange of it. placed: df's partitions are such buckets already, one bucket each at most."""
    spark = df.sparkSession
    table = f"textloom_{name.replace('-', '_')}_{uuid.uuid4().hex}"
    df = df if placed else df.repartition(parts, *keys)
    df.write.format("parquet").option("compression", "zstd").option("path", f"{shared_dir(spark)}/{table}").bucketBy(parts, *keys).sortBy(*keys).saveAsTable(table)
    return table


def placed(df: DataFrame, keys: list[str], parts: int) -> DataFrame:
    """df dealt to ``parts`` partitions by a hash of keys, sorted by them and kept on the executors' disks until unpersist():
    joins and groups by keys exchange nothing, and what a lost executor had is computed again."""
    return df.repartition(parts, *keys).sortWithinPartitions(*keys).persist(StorageLevel.DISK_ONLY)


def drop_bucketed(spark: SparkSession, table: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    drop(spark, f"{shared_dir(spark)}/{table}")


def drop(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def parts_for(spark: SparkSession, n_bytes: int, per_part: int) -> int:
    """Partitions of about per_part bytes, never fewer than the session's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // per_part))


def free_name(docs: DataFrame, name: str) -> str:
    """name, or name with as many underscores as docs need to have no such column."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def size_of(docs: DataFrame) -> int:
    """Bytes of docs by the optimizer's statistics, which take compressed files as they are; only where it knows none, by
    a pass over the texts. It chooses numbers of partitions only."""
    known = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if known < 1 << 55:
        return known
    return docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
