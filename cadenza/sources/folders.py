"""Dataset folders as a data source: ``entries/{id}.json``, one object each, and ``metadata.json`` beside them.

``spark.read.format("dataset_folder").load(path)`` gives (file_name, raw) of all entry files, and
``df.write.format("dataset_folder").mode("append").save(path)`` writes rows (id, raw).  ``read`` and ``write``
put entries with their types around that.

A file is written under a temporary name and renamed by its task, so that a reader never sees half of
one and a repeated task replaces its own files.  The job removes the metadata before the first task
and writes it after the last: a folder with metadata is whole."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from . import entries

#: Bytes of files that one task reads, where opening a file counts as some, and of one batch of rows.
TASK_BYTES, OPEN_BYTES, BATCH_BYTES = 64 << 20, 64 << 10, 4 << 20


def _listed(fs: pafs.FileSystem, home: str) -> list[tuple[str, int]]:
    """Entry files (name, bytes) by name."""
    found = fs.get_file_info(pafs.FileSelector(f"{home}/entries", allow_not_found=True))
    return sorted((f.base_name, f.size) for f in found if f.is_file and f.base_name.endswith(".json") and not f.base_name.startswith("."))


@dataclass
class Files(InputPartition):
    names: list[str]


@dataclass
class Done(WriterCommitMessage):
    rows: int


class FolderReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Files]:
        fs, home = pafs.FileSystem.from_uri(self.path)
        for name in ("", "/entries"):
            if fs.get_file_info(home + name).type != pafs.FileType.Directory:
                raise ValueError(f"no such directory: {self.path}{name}")
        parts, held = [Files([])], 0
        for name, size in _listed(fs, home):
            if held and held + size + OPEN_BYTES > TASK_BYTES:
                parts.append(Files([]))
                held = 0
            parts[-1].names.append(name)
            held += size + OPEN_BYTES
        return parts

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs, home = pafs.FileSystem.from_uri(self.path)
        rows, held = [], 0
        for name in partition.names:
            with fs.open_input_stream(f"{home}/entries/{name}") as file:
                data = file.read()
            try:
                text = data.decode()
                json.loads(text)
            except ValueError as error:
                raise ValueError(f"cannot read entry {name}: {error}") from error
            rows.append((name, text))
            held += len(data)
            if held > BATCH_BYTES:
                yield self.batch(rows)
                rows, held = [], 0
        if rows:
            yield self.batch(rows)

    def batch(self, rows: list[tuple[str, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()) for c in zip(*rows, strict=True)], ["file_name", "raw"])


class FolderWriter(DataSourceArrowWriter):
    def __init__(self, path: str, meta: dict[str, str], replace: bool):
        self.path, self.meta = path, meta
        fs, home = pafs.FileSystem.from_uri(path)
        fs.create_dir(f"{home}/entries")
        if fs.get_file_info(f"{home}/metadata.json").is_file:
            fs.delete_file(f"{home}/metadata.json")
        if replace:
            fs.delete_dir_contents(f"{home}/entries")
        self.before = len(_listed(fs, home))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Done:
        fs, home = pafs.FileSystem.from_uri(self.path)
        n = 0
        for batch in iterator:
            for name, raw in zip(batch["id"].to_pylist(), batch["raw"].to_pylist(), strict=True):
                if not name or name.startswith(".") or "/" in name or "\0" in name:
                    raise ValueError(f"no file can be named after the id {name!r}")
                draft = f"{home}/entries/.{uuid.uuid4().hex}"
                with fs.open_output_stream(draft) as out:
                    out.write((raw or "null").encode())
                fs.move(draft, f"{home}/entries/{name}.json")
                n += 1
        return Done(n)

    def commit(self, messages: list[Done | None]) -> None:
        fs, home = pafs.FileSystem.from_uri(self.path)
        size, rows = len(_listed(fs, home)), self.before + sum(m.rows for m in messages if m)
        if size != rows:
            raise ValueError(f"{rows} entries have only {size} different ids")
        draft = f"{home}/.{uuid.uuid4().hex}"
        with fs.open_output_stream(draft) as out:
            out.write(json.dumps({**self.meta, "size": size}).encode())
        fs.move(draft, f"{home}/metadata.json")

    def abort(self, messages: list[Done | None]) -> None:
        """The files that tasks have finished stay; without metadata they are no dataset."""


class DatasetFolder(DataSource):
    """Options: ``path``, and for the metadata ``title``, ``version``, ``source`` and ``language``."""

    @classmethod
    def name(cls) -> str:
        return "dataset_folder"

    def schema(self) -> str:
        return "file_name string, raw string"

    def reader(self, schema) -> FolderReader:
        return FolderReader(self.options["path"].rstrip("/"))

    def writer(self, schema, overwrite: bool) -> FolderWriter:
        path = self.options["path"].rstrip("/")
        meta = {"name": self.options.get("title", path.rsplit("/", 1)[-1]), "version": self.options.get("version", "1.0")}
        return FolderWriter(path, meta | {k: self.options[k] for k in ("source", "language") if k in self.options}, overwrite)


def register(spark: SparkSession) -> None:
    """Make ``dataset_folder`` known.  The source travels by value, as whole sessions may not have this package."""
    import sys

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    try:
        spark.dataSource.register(DatasetFolder)
    finally:
        cloudpickle.unregister_pickle_by_value(sys.modules[__name__])


def read(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a folder as ``entries.entries`` types them.  A folder without ``entries`` fails, as does a
    file that is no JSON or no entry, by name; an empty folder gives no rows."""
    register(spark)
    rows = entries.judged(spark.read.format("dataset_folder").load(path))
    named = F.when(F.col("reason").isNull(), F.col("file_name")).otherwise(F.raise_error(F.concat(F.lit("cannot read entry "), "file_name", F.lit(": "), "reason")))
    return entries.entries(rows.withColumn("file_name", named))


def write(rows: DataFrame, path: str, mode: str = "append", **meta: str) -> None:
    """``rows`` as a dataset folder, a file for each under its ``id``, which must be there and differ from row to row.
    Null fields are left out; ``overwrite`` takes the earlier entries away."""
    register(rows.sparkSession)
    out = rows.select(F.col("id").cast("string").alias("id"), F.to_json(F.struct("*")).alias("raw")).write.format("dataset_folder").mode(mode)
    for key, value in meta.items():
        out = out.option(key, value)
    out.save(path)
