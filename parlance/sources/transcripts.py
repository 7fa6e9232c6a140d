"""A folder of transcripts as a data source: one file for each conversation.

``spark.dataSource.register(TranscriptFolder)``, then ``exports.write.format("transcripts").mode("append").save(path)`` writes
``conv_id, filename, content``, and ``spark.read.format("transcripts").load(path)`` gives the same columns back. The folder has to be one that
the driver and all executors have mounted.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Row
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = "conv_id long, filename string, content string"
#: Bytes of files that a task reads, about.
TASK_BYTES = 64 << 20


def _folder(options: dict) -> str:
    path = options.get("path", "")
    if not path:
        raise ValueError("a path is needed")
    return re.sub(r"^file:(//)?", "", path)


@dataclass
class Files(InputPartition):
    names: list[str]


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class TranscriptReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = _folder(options)

    def partitions(self) -> list[Files]:
        """Files by size, so that tasks read about as much."""
        out, held, size = [], [], 0
        with os.scandir(self.folder) as entries:
            found = sorted((e.name, e.stat().st_size) for e in entries if e.is_file() and re.match(r"-?\d+-", e.name))
        for name, n in found:
            if held and size + n > TASK_BYTES:
                out.append(Files(held))
                held, size = [], 0
            held.append(name)
            size += n
        return [*out, Files(held)]

    def read(self, partition: Files) -> Iterator[tuple]:
        for name in partition.names:
            with open(os.path.join(self.folder, name), encoding="utf-8", newline="") as file:
                conv_id, _, rest = name.removeprefix("-").partition("-")
                yield (-int(conv_id) if name.startswith("-") else int(conv_id)), rest, file.read()


class TranscriptWriter(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.folder, self.overwrite = _folder(options), overwrite

    def write(self, rows: Iterator[Row]) -> Written:
        """Each file appears whole under its name or not at all; a task that runs again writes the same names."""
        os.makedirs(self.folder, exist_ok=True)
        names = []
        for row in rows:
            name = f"{row['conv_id']}-" + re.sub(r"[/\\\x00]", "_", row["filename"] or "conversation.md")
            part = os.path.join(self.folder, f".{name}.{os.getpid()}.part")
            with open(part, "w", encoding="utf-8", newline="") as file:
                file.write(row["content"] or "")
            os.replace(part, os.path.join(self.folder, name))
            names.append(name)
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        """Files that an overwriting save didn't write go; a mark says that all are there."""
        kept = {n for m in messages if m for n in m.names}
        if self.overwrite:
            for name in os.listdir(self.folder) if os.path.isdir(self.folder) else ():
                if re.match(r"-?\d+-", name) and name not in kept:
                    os.remove(os.path.join(self.folder, name))
        os.makedirs(self.folder, exist_ok=True)
        with open(os.path.join(self.folder, "_SUCCESS"), "w"):
            pass

    def abort(self, messages: list[Written | None]) -> None:
        """What finished tasks wrote is taken back."""
        for name in (n for m in messages if m for n in m.names):
            path = os.path.join(self.folder, name)
            if os.path.exists(path):
                os.remove(path)


class TranscriptFolder(DataSource):
    @classmethod
    def name(cls) -> str:
        return "transcripts"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TranscriptReader:
        return TranscriptReader(self.options)

    def writer(self, schema, overwrite: bool) -> TranscriptWriter:
        return TranscriptWriter(self.options, overwrite)
