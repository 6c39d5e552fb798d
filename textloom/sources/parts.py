"""Part files of a job that was interrupted: torn files are told by their sizes, whole rows kept, and merged tables replaced
as a whole."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators.relational import latest
from textloom.sources import files

#: The file that names a folder's version in use.
CURRENT = "CURRENT"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    about = [F.col(f"_metadata.{c}").alias(n) for c, n in (("file_path", "_file"), ("file_size", "_size"), ("file_modification_time", "_time"), ("file_block_start", "_block"))]
    return spark.read.option("lineSep", "\n").text(path).select(F.col("value").alias("_line"), *about, F.monotonically_increasing_id().alias("_at"))


def read_parts(spark: SparkSession, path: str, schema: str, header: str) -> DataFrame:
    """Lines of CSV part files below path: the columns of ``schema``, _file, _time (when the file was changed), _at (rises
    within a file) and _fault: null for whole rows, else 'torn', 'other columns' or 'malformed', with the columns null.

    A file whose lines and line ends add up to more than its size lacks the last line end: its last line is torn, even if
    it reads like a row whose last value was cut. A file that doesn't begin with ``header`` has other columns. A line with
    too few or too many values, or one that isn't of its type, is malformed. The header and empty lines are no rows. A file is read by as many tasks as it has splits; no task has more than a split. For uncompressed files whose
    values have no line ends in them.
    """
    lines = _lines(spark, path)
    text = F.regexp_replace("_line", "\r$", "")
    place = F.struct("_block", "_at", "_line")
    about = lines.groupBy("_file").agg(F.min(place).alias("_head"), F.max(place).alias("_last"), (F.sum(F.octet_length("_line") + 1) > F.max("_size")).alias("_open"))
    about = about.select("_file", F.regexp_replace("_head._line", "\r$", "").alias("_header"), F.col("_head._at").alias("_first"), F.when(F.col("_open"), F.col("_last._at")).alias("_torn"))
    rows = lines.join(about, "_file")
    row = F.from_csv(text, f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    torn, other = F.coalesce(F.col("_at") == F.col("_torn"), F.lit(False)), F.col("_header") != header
    rows = rows.where((torn | other | (F.col("_at") != F.col("_first"))) & (text != "")).withColumn("_row", F.when(~torn & ~other, row))
    fault = F.when(torn, "torn").when(other, "other columns").when(F.col("_row._bad").isNotNull(), "malformed")
    names = spark.createDataFrame([], schema).columns
    rows = rows.withColumn("_fault", fault)
    return rows.select(*[F.when(F.col("_fault").isNull(), F.col("_row")[n]).alias(n) for n in names], "_file", "_time", "_at", "_fault")


def faults(parts: DataFrame) -> DataFrame:
    """(file, rows, torn, malformed, other_columns) of every file of ``read_parts`` that has lines beside its header: whole
    rows, and lines that were set aside."""
    count = lambda f: F.count_if(F.col("_fault") == f)
    return parts.groupBy(F.col("_file").alias("file")).agg(F.count_if(F.col("_fault").isNull()).alias("rows"), count("torn").alias("torn"), count("malformed").alias("malformed"), count("other columns").alias("other_columns"))


def salvaged(done: DataFrame, parts: DataFrame, key: str, needed: list[str]) -> DataFrame:
    """done and, of the keys that it lacks, the whole rows of ``read_parts`` with values in all ``needed`` columns; of several
    rows of a key the one of the file changed last, of equal ones the last by name and place. A null key is no key."""
    new = parts.where("_fault is null").dropna(subset=[key, *needed]).join(done.select(key), key, "left_anti")
    return done.unionByName(latest(new, key, ["_time", "_file", "_at"]).select(*done.columns))


def replace_table(df: DataFrame, folder: str) -> str:
    """Writes df as a new version in folder and then makes it the one in use: a job that dies before leaves the old one in
    use. df may read the version in use. Gives the new version's name; old versions stay."""
    name = f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{folder}/{name}")
    files.put(f"{folder}/{CURRENT}", name.encode())
    return name


def current_table(spark: SparkSession, folder: str) -> DataFrame | None:
    """The version in use of a folder, or None where there is none."""
    if not files.exists(f"{folder}/{CURRENT}"):
        return None
    return spark.read.parquet(f"{folder}/{files.get(f'{folder}/{CURRENT}').decode()}")
