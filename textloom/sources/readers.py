"""Readers of learner corpora: CSV as strings, workbooks, text files named by their labels."""

from __future__ import annotations

import io
import itertools
import json
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions import scalars as S
from textloom.sources import files, textfiles


def read_csv(spark: SparkSession, path: str, columns: list[str] | None = None, short_rows: str = "pad") -> DataFrame:
    """A CSV file (plain or gzip) with header, all strings. short_rows: "pad" fills missing cells with null, "drop"
    leaves out rows of the wrong length."""
    reader = spark.read.option("header", True).option("multiLine", False).option("mode", "PERMISSIVE" if short_rows == "pad" else "DROPMALFORMED")
    if columns:
        reader = reader.schema(", ".join(f"`{c}` string" for c in columns))
    return reader.csv(path)


def with_fallback(path: str) -> str:
    """path, or path.gz where only that is there; Spark reads either, from any file system."""
    return path if files.exists(path) or not files.exists(path + ".gz") else path + ".gz"


def header(names: list[str]) -> list[str]:
    """Names stripped and case-folded; empty or repeated ones raise."""
    out = [n.strip().casefold() for n in names]
    if "" in out or len(set(out)) < len(out):
        raise ValueError("empty or repeated column name")
    return out


def read_metadata(spark: SparkSession, path: str, required: list[str], whole: list[str]) -> DataFrame:
    """A strict CSV table: its header holds ``required``, its first required column is unique, and ``whole`` columns are
    integers in every row."""
    df = read_csv(spark, path)
    df = df.toDF(*header(df.columns))
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    df = df.withColumns({c: S.integer_id(F.col(c)) for c in whole})
    bad = F.lit(False)
    for c in [required[0], *whole]:
        bad = bad | F.col(c).isNull()
    n, distinct, wrong = df.agg(F.count("*"), F.countDistinct(required[0]), F.count_if(bad)).first()
    if wrong or n != distinct:
        raise ValueError("null, repeated or malformed cells")
    return df


_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def _cells(z: zipfile.ZipFile, sheet: int) -> Iterator[list[tuple[int, str, str | None]]]:
    """For each row of a sheet its cells: column, kind, text. The sheet's XML is never whole in memory."""
    with z.open(f"xl/worksheets/sheet{sheet}.xml") as f:
        for _, e in ET.iterparse(f):
            if e.tag != f"{_SHEET}row":
                continue
            row, at = [], 0
            for c in e.iter(f"{_SHEET}c"):
                letters = re.match(r"[A-Z]+", c.get("r") or "")
                if letters:
                    at = sum((ord(x) - 64) * 26**i for i, x in enumerate(reversed(letters[0]))) - 1
                v = c.find(f"{_SHEET}v")
                text = "".join(t.text or "" for t in c.iter(f"{_SHEET}t")) if c.get("t") == "inlineStr" else (v.text if v is not None else None)
                row.append((at, c.get("t") or "", text))
                at += 1
            yield row
            e.clear()


def _shared(z: zipfile.ZipFile, wanted: set[int] | None) -> dict[int, str]:
    """The shared strings of the wanted numbers (None: all)."""
    out: dict[int, str] = {}
    if "xl/sharedStrings.xml" in z.namelist():
        with z.open("xl/sharedStrings.xml") as f:
            for n, e in enumerate(e for _, e in ET.iterparse(f) if e.tag == f"{_SHEET}si"):
                if wanted is None or n in wanted:
                    out[n] = "".join(t.text or "" for t in e.iter(f"{_SHEET}t"))
                e.clear()
    return out


def xlsx_rows(book: str | io.BytesIO, sheet: int = 1, columns: list[int] | None = None) -> Iterator[list[str | None]]:
    """The rows of a workbook's sheet as text, cell by cell. columns: only these are decoded, and only the shared strings
    that they use are kept."""
    with zipfile.ZipFile(book) as z:
        wanted = None if columns is None else {int(t) for row in _cells(z, sheet) for at, kind, t in row if kind == "s" and t is not None and at in columns}
        shared = _shared(z, wanted)
        for cells in _cells(z, sheet):
            row: list[str | None] = [None] * (max((at for at, _, _ in cells), default=-1) + 1)
            for at, kind, text in cells:
                if columns is None or at in columns:
                    row[at] = shared[int(text)] if kind == "s" and text is not None else text
            yield row if columns is None else [row[c] if c < len(row) else None for c in columns]


def read_xlsx(spark: SparkSession, path: str, required: list[str], sheet: int = 1) -> DataFrame:
    """The required columns of the workbooks at a path, as strings; rows without the first one go. A workbook is one task,
    which decodes its sheet cell by cell and gives it in chunks; only headers come to the driver."""
    books = spark.read.format("binaryFile").load(path).select("path", "content")

    def heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"path": pdf["path"], "names": [[(n or "").strip().lower() for n in next(xlsx_rows(io.BytesIO(c), sheet), [])] for c in pdf["content"]]})

    places: dict[str, list[int]] = {}
    for r in books.mapInPandas(heads, "path string, names array<string>").collect():
        missing = [c for c in required if c not in r["names"]]
        if missing:
            raise ValueError(f"missing columns: {missing}")
        places[r["path"]] = [r["names"].index(c) for c in required]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                found = xlsx_rows(io.BytesIO(content), sheet, places[name])
                next(found)
                while chunk := [r for r in itertools.islice(found, 10_000)]:
                    yield pd.DataFrame([r for r in chunk if r[0] not in (None, "")], columns=required, dtype="object")

    return books.mapInPandas(rows, ", ".join(f"`{c}` string" for c in required))


@F.pandas_udf(T.StringType())
def decoded(content: pd.Series) -> pd.Series:
    """Bytes to text: UTF-8 with or without a mark, else UTF-16 with a mark, else cp1252; NUL becomes a space. UTF-16 is
    taken only with its mark: without one nearly any bytes would pass as UTF-16, and cp1252 would never be tried."""

    def one(raw: bytes) -> str:
        for name in ("utf-8-sig", "utf-16"):
            if name == "utf-16" and raw[:2] not in (b"\xff\xfe", b"\xfe\xff"):
                continue
            try:
                return raw.decode(name).replace("\0", " ")
            except UnicodeDecodeError:
                pass
        return raw.decode("cp1252", errors="replace").replace("\0", " ")

    return content.map(one, na_action="ignore")


def read_text_files(spark: SparkSession, folder: str) -> DataFrame:
    """(filename, writing_id, cefr_level, level, text) of the text files in a folder, labels from their names."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(folder)
    name = S.base_name(F.col("path"))
    return files.select(name.alias("filename"), S.id_of_name(name).alias("writing_id"), S.band_of_name(name).alias("cefr_level"), S.level_of_name(name).alias("level"), decoded("content").alias("text"))


def list_names(spark: SparkSession, folder: str) -> DataFrame:
    """(filename, cefr_level, level) of the text files in a folder, without reading them."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(folder)
    name = S.base_name(F.col("path"))
    return files.select(name.alias("filename"), S.band_of_name(name).alias("cefr_level"), S.level_of_name(name).alias("level"))


def read_json(path: str) -> dict:
    return json.loads(files.get(path))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(filename, text) of a folder that ``writers.write_texts`` wrote; every task lists and reads its own folder of files."""
    return spark.read.format(textfiles.registered(spark)).load(path)


def read_scores(spark: SparkSession, path: str, required: dict[str, str], sources: list[str] | None = None) -> DataFrame:
    """Stored scores with the required columns, cast to their types (a cell that doesn't fit raises); others may follow. A
    missing column raises. sources: only rows of these."""
    out = spark.read.parquet(path)
    missing = [c for c in required if c not in out.columns]
    if missing:
        raise ValueError(f"stored scores lack columns: {missing}; score them again")
    out = out.withColumns({c: F.col(c).cast(kind) for c, kind in required.items()})
    return out if sources is None else out.where(F.col("source").isin(list(sources)))


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Saved predictions in the stable order of their texts' ids, labels as strings."""
    out = spark.read.parquet(path)
    return out.withColumns({c: F.col(c).cast("string") for c in ("cefr_level", "predicted_cefr") if c in out.columns}).orderBy("text_id")
