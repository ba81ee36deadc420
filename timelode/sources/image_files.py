"""Files of a folder as a table, and a table as files, all or none of them.

    spark.dataSource.register(ImageFiles)
    spark.read.format("image_files").load(folder)
    rows.write.format("image_files").mode("append").save(folder)

Rows are (name: path below the folder, content: bytes). Reading deals files to partitions of about
``PART`` bytes and hands them on in batches of about ``BATCH`` bytes, and writing takes one file of a batch
at a time, so a task holds a few files however many there are. Writing puts a task's files below ``_staged-<job>`` first; they get
their names when the whole job has ended, so a job that fails leaves no file,
and a task that runs twice writes the same ones. Folders are on a file system
that the driver and all executors reach.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from timelode.operators.memory import give_back

PART, BATCH = 64_000_000, 4_000_000
SCHEMA = "name string, content binary"


def _open(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def _files(system, root: str, skip: str = "_") -> list:
    """Files below root, but for what starts with ``skip`` there; in order of their names."""
    from pyarrow import fs

    found = system.get_file_info(fs.FileSelector(root, allow_not_found=True, recursive=True))
    return sorted((f for f in found if f.is_file and not f.path[len(root) + 1 :].startswith(skip)), key=lambda f: f.path)


@dataclass
class Names(InputPartition):
    names: list[str]


class Reader(DataSourceReader):
    def __init__(self, folder: str) -> None:
        self.folder = folder

    def partitions(self) -> list[Names]:
        system, root = _open(self.folder)
        parts, size = [], PART
        for f in _files(system, root):
            if size + f.size > PART and size:
                parts.append(Names([]))
                size = 0
            parts[-1].names.append(f.path[len(root) + 1 :])
            size += f.size
        return parts or [Names([])]

    def read(self, partition: Names) -> Iterator[pa.RecordBatch]:
        system, root = _open(self.folder)
        batch = lambda names, contents: pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(contents, pa.binary())], names=["name", "content"])
        names, contents, size = [], [], 0
        for name in partition.names:
            with system.open_input_stream(f"{root}/{name}") as file:
                names.append(name)
                contents.append(file.read())
            size += len(contents[-1])
            if size >= BATCH:
                yield batch(names, contents)
                names, contents, size = [], [], 0
        if names:
            yield batch(names, contents)
        del names, contents
        give_back()


@dataclass
class Staged(WriterCommitMessage):
    names: list[str]
    place: str


class Writer(DataSourceArrowWriter):
    def __init__(self, folder: str) -> None:
        self.folder, self.staged = folder, f"_staged-{uuid.uuid4().hex}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Staged:
        from pyspark import TaskContext

        system, root = _open(self.folder)
        context = TaskContext.get()
        place, names = f"{self.staged}/{context.partitionId()}-{context.attemptNumber()}", []
        for name, content in ((b.column("name")[i].as_py(), b.column("content")[i]) for b in batches for i in range(b.num_rows)):
            if name.startswith(("/", "_")) or ".." in name.split("/"):
                raise ValueError(f"not a name below the folder: {name}")
            path = f"{root}/{place}/{name}"
            system.create_dir(path.rsplit("/", 1)[0], recursive=True)
            with system.open_output_stream(path) as out:
                out.write(content.as_buffer())
            names.append(name)
        give_back()
        return Staged(names, place)

    def commit(self, messages: list[Staged | None]) -> None:
        system, root = _open(self.folder)
        for message in messages:
            for name in message.names if message else []:
                system.create_dir(f"{root}/{name}".rsplit("/", 1)[0], recursive=True)
                system.move(f"{root}/{message.place}/{name}", f"{root}/{name}")
        self._clear(system, root)

    def abort(self, messages: list[Staged | None]) -> None:
        self._clear(*_open(self.folder))

    def _clear(self, system, root: str) -> None:
        from pyarrow import fs

        if system.get_file_info(f"{root}/{self.staged}").type != fs.FileType.NotFound:
            system.delete_dir(f"{root}/{self.staged}")


class ImageFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "image_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> Writer:
        if overwrite:
            raise ValueError("image_files only adds files: use mode('append')")
        return Writer(self.options["path"])
