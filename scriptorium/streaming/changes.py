"""A stream of files that are new or were written again."""

from __future__ import annotations

import time
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from scriptorium.sources.files import BYTES_OF_TASK, FILES, FILES_OF_TASK, SUPPORTED, folder_entries, open_system, read_file

#: Files younger than this wait for the next batch, as more may be written at the same time.
SETTLE_SECONDS = 1.0


class Files(InputPartition):
    def __init__(self, files: list[tuple[str, int, int]]):
        self.files = files


class ChangedFilesReader(DataSourceStreamReader):
    """Offsets are times of last change, in nanoseconds; a batch has the files changed after one and up to another."""

    def __init__(self, path: str, settle: float):
        self.path, self.settle = path, settle

    def _files(self) -> Iterator[fs.FileInfo]:
        """Supported files below the path, a folder at a time."""
        prefix = self.path[: len(self.path) - len(open_system(self.path)[1])]
        todo = [self.path]
        while todo:
            for entry in folder_entries(todo.pop()):
                if entry.type == fs.FileType.Directory:
                    todo.append(prefix + entry.path)
                elif entry.base_name.lower().endswith(SUPPORTED):
                    yield entry

    def initialOffset(self) -> dict:
        return {"at": 0}

    def latestOffset(self) -> dict:
        until = time.time_ns() - int(self.settle * 1e9)
        return {"at": max((f.mtime_ns for f in self._files() if f.mtime_ns <= until), default=0)}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        prefix = self.path[: len(self.path) - len(open_system(self.path)[1])]
        out, held, size = [], [], 0
        for f in self._files():
            if start["at"] < f.mtime_ns <= end["at"]:
                held.append((prefix + f.path, f.mtime_ns, f.size))
                size += f.size
                if len(held) >= FILES_OF_TASK or size >= BYTES_OF_TASK:
                    out.append(Files(held))
                    held, size = [], 0
        return [*out, Files(held)] if held or not out else out

    def read(self, partition: Files) -> Iterator[tuple]:
        from datetime import datetime, timezone

        for path, changed, size in partition.files:
            content = read_file(path)
            if content is not None:
                yield (path, datetime.fromtimestamp(changed / 1e9, timezone.utc), size, content)

    def commit(self, end: dict) -> None:
        pass


class ChangedFiles(DataSource):
    """spark.readStream.format("changed_files").option("path", ...): rows (path, modificationTime, length, content).

    A path comes again whenever its file is written again. A file that is moved in with a time
    older than the last batch is not seen; index_files finds it. Only the files of a batch are
    kept by the planner. Option settle: see SETTLE_SECONDS.
    """

    @classmethod
    def name(cls) -> str:
        return "changed_files"

    def schema(self) -> str:
        return FILES

    def streamReader(self, schema: StructType) -> ChangedFilesReader:
        return ChangedFilesReader(self.options["path"], float(self.options.get("settle", SETTLE_SECONDS)))
