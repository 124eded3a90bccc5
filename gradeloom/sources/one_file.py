"""A sink that makes one text file of a frame's rows: tasks write parts, the commit puts them together.

Each task writes its texts to a file of its own under a name that no other attempt has, and only what a successful attempt has told is used: a task that
fails or runs twice leaves nothing behind. The commit joins the parts as bytes in blocks, in the order of the frame's partitions, beside the file and renames it,
so that a reader never sees half of one. No row passes through the driver's Python. File systems are those of ``pyarrow.fs``.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

from pyarrow import RecordBatch
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

BLOCK = 8 << 20


def located(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path else Path(path).absolute().as_uri())


@dataclass
class Part(WriterCommitMessage):
    number: int
    name: str
    rows: int


class OneFileWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.begin, self.between, self.end, self.empty = (options.get(x, d) for x, d in (("begin", ""), ("between", "\n"), ("end", "\n"), ("empty", "")))
        self.parts = f"{self.path}.{uuid.uuid4().hex}.parts"
        fs, top = located(self.parts)
        fs.create_dir(top, recursive=True)  # once: a task that outlives an abort finds no folder to write to

    def write(self, iterator: Iterator[RecordBatch]) -> Part:
        fs, top = located(self.parts)
        number, rows = TaskContext.get().partitionId(), 0
        name = f"{number:08d}.{uuid.uuid4().hex}"
        with fs.open_output_stream(f"{top}/{name}") as out:
            for b in iterator:
                for text in b.column(0).to_pylist():
                    out.write(((self.between if rows else "") + text).encode())
                    rows += 1
        return Part(number, name, rows)

    def commit(self, messages: list[Part | None]) -> None:
        fs, top = located(self.parts)
        _, path = located(self.path)
        whole = f"{path}.{uuid.uuid4().hex}.new"
        with fs.open_output_stream(whole) as out:
            out.write(self.begin.encode())
            first = True
            for part in sorted((m for m in messages if m is not None and m.rows), key=lambda m: m.number):
                out.write(("" if first else self.between).encode())
                first = False
                with fs.open_input_stream(f"{top}/{part.name}") as piece:
                    while block := piece.read(BLOCK):
                        out.write(block)
            out.write(((self.empty if first else "") + self.end).encode())
        fs.move(whole, path)
        self._clear()

    def abort(self, messages: list[Part | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        fs, top = located(self.parts)
        if fs.get_file_info(top).type == pafs.FileType.Directory:
            fs.delete_dir(top)


class OneFile(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gradeloom_one_file"

    def writer(self, schema, overwrite: bool) -> OneFileWriter:
        return OneFileWriter(self.options)


def write_one_file(texts: DataFrame, path: str, begin: str = "", between: str = "\n", end: str = "\n", empty: str = "") -> None:
    """The only column's texts (no nulls) as one file, in the order of the frame's partitions and the rows within; ``empty`` stands for no rows. Replaces a file that is there."""
    texts.sparkSession.dataSource.register(OneFile)
    texts.write.format(OneFile.name()).mode("append").options(path=path, begin=begin, between=between, end=end, empty=empty).save()
