"""Named text files, one for each text, that tasks write and read by themselves: a data source of Spark."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: Files of a folder at most; bytes and files of a batch that is read.
FOLDER, BATCH_BYTES, BATCH_FILES = 5_000, 4 << 20, 1_000


def _file(name: str | None, again: int) -> str:
    """A file's name: what no path can have, and a first . or _, as % and two digits; a null is %null. A name that occurs
    again has %r and how often at its end, which no other name can have."""
    own = "%null" if name is None else re.sub(r"[%/\\:\x00-\x1f\x7f]|^[._]", lambda m: f"%{ord(m[0]):02X}", name)
    return f"{own}%r{again}.txt" if again else f"{own}.txt"


def _name(file: str) -> str | None:
    own = re.sub(r"(%r\d+)?\.txt\Z", "", file)
    return None if own == "%null" else unquote(own)


@dataclass
class Folders(WriterCommitMessage):
    paths: list[str]


class Writer(DataSourceArrowWriter):
    """Tasks write below _temporary, each attempt in folders of its own; the commit moves the folders of those that count."""

    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite = path, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Folders:
        """Rows (filename, text) sorted by filename, so that a repeated name follows itself."""
        files, root = fs.FileSystem.from_uri(self.path)
        made, n, last, again = Folders([]), 0, "", 0
        for batch in iterator:
            texts = batch.column(1).cast(pa.binary())
            for name, text in zip(batch.column(0).to_pylist(), texts, strict=True):
                again = again + 1 if n and name == last else 0
                if n % FOLDER == 0:
                    made.paths.append(f"{root}/_temporary/{uuid.uuid4().hex}")
                    files.create_dir(made.paths[-1])
                with files.open_output_stream(f"{made.paths[-1]}/{_file(name, again)}") as out:
                    out.write(text.as_buffer())
                last, n = name, n + 1
        return made

    def commit(self, messages: list[Folders | None]) -> None:
        files, root = fs.FileSystem.from_uri(self.path)
        files.create_dir(root)
        if self.overwrite:
            if files.get_file_info(f"{root}/_SUCCESS").type == fs.FileType.File:
                files.delete_file(f"{root}/_SUCCESS")
            for old in _parts(files, root):
                files.delete_dir(old)
        for made in messages:
            for path in made.paths if made else []:
                files.move(path, f"{root}/part-{path.rsplit('/', 1)[1]}")
        if files.get_file_info(f"{root}/_temporary").type == fs.FileType.Directory:
            files.delete_dir(f"{root}/_temporary")
        files.open_output_stream(f"{root}/_SUCCESS").close()

    def abort(self, messages: list[Folders | None]) -> None:
        files, _ = fs.FileSystem.from_uri(self.path)
        for made in messages:
            for path in made.paths if made else []:
                files.delete_dir(path)


def _parts(files: fs.FileSystem, root: str) -> list[str]:
    found = files.get_file_info(fs.FileSelector(root))
    return sorted(f.path for f in found if f.type == fs.FileType.Directory and f.base_name.startswith("part-"))


class Reader(DataSourceReader):
    """A folder a task: names are listed where they are read."""

    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[InputPartition]:
        files, root = fs.FileSystem.from_uri(self.path)
        if files.get_file_info(f"{root}/_SUCCESS").type != fs.FileType.File:
            raise FileNotFoundError(f"no finished folder of texts: {self.path}")
        return [InputPartition(p) for p in _parts(files, root)] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition.value is None:
            return
        files, _ = fs.FileSystem.from_uri(self.path)
        names, texts, size = [], [], 0
        for f in files.get_file_info(fs.FileSelector(partition.value)):
            with files.open_input_stream(f.path) as data:
                texts.append(data.read())
            names.append(_name(f.base_name))
            size += len(texts[-1])
            if size >= BATCH_BYTES or len(names) >= BATCH_FILES:
                yield _batch(names, texts)
                names, texts, size = [], [], 0
        if names:
            yield _batch(names, texts)


def _batch(names: list[str | None], texts: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(texts, pa.binary()).cast(pa.string())], ["filename", "text"])


class TextFiles(DataSource):
    """``filename`` and ``text`` of files named <filename>.txt, at most FOLDER of them in a folder."""

    @classmethod
    def name(cls) -> str:
        return "textfiles"

    def schema(self) -> str:
        return "filename string, text string"

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options["path"], overwrite)


def registered(spark: SparkSession) -> str:
    spark.dataSource.register(TextFiles)
    return TextFiles.name()
