"""Single-file sinks: one JSON array, one JSON object or one report, whole or not at all.

``df.write.format("one_file").option("path", ...).option("kind", "array").mode("overwrite").save()`` after
``register(spark)``.  Tasks write parts beside the target; the commit strings them together in the order of the partitions
and moves the file into place, an abort removes the parts and leaves the old file.  Such a file is read by one reader, so
it is meant for lists and reports; ``limit`` (bytes) stops one that is not.
"""
from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

KINDS = {"array": ("[", ",", "]"), "map": ("{", ",", "}"), "report": ("", "", "")}
LIMIT = 1 << 30
_CHUNK = 1 << 20


def _files(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


@dataclass
class Part(WriterCommitMessage):
    name: str
    number: int
    rows: int
    size: int


class _Writer(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.kind, self.overwrite = options["path"], options.get("kind", "array"), overwrite
        self.limit = int(options.get("limit", LIMIT))
        self.token = uuid.uuid4().hex
        if self.kind not in KINDS:
            raise ValueError(f"kind must be one of {', '.join(KINDS)}")
        store, path = _files(self.path)
        folder, _, name = path.rpartition("/")
        #: The parts' folder, which readers of the target's folder pass over.
        self.beside = f"{folder}/_{name}.{self.token}" if folder else f"_{name}.{self.token}"
        store.create_dir(self.beside, recursive=True)

    def _line(self, row) -> str:
        if self.kind == "report":
            return f"{row[0]}\n"
        if self.kind == "map":
            return f"{json.dumps(row[0], ensure_ascii=False)}:{json.dumps(row[1], ensure_ascii=False)}"
        return json.dumps(row[0] if len(row) == 1 else row.asDict(True), ensure_ascii=False)

    def write(self, iterator: Iterator) -> Part:
        store, _ = _files(self.path)
        task = TaskContext.get()
        name, rows, size, between = f"{self.beside}/{task.partitionId()}.{task.taskAttemptId()}", 0, 0, KINDS[self.kind][1]
        with store.open_output_stream(name) as out:
            for row in iterator:
                data = ((between if rows else "") + self._line(row)).encode()
                out.write(data)
                rows, size = rows + 1, size + len(data)
        return Part(name, task.partitionId(), rows, size)

    def commit(self, messages: list) -> None:
        store, path = _files(self.path)
        parts = sorted((m for m in messages if m is not None), key=lambda m: m.number)
        whole = f"{self.beside}/whole"
        begin, between, end = KINDS[self.kind]
        try:
            if sum(m.size for m in parts) > self.limit:
                raise ValueError(f"more than {self.limit} bytes for one file; write a folder of files instead")
            if not self.overwrite and store.get_file_info(path).type.name != "NotFound":
                raise FileExistsError(path)
            with store.open_output_stream(whole) as out:
                out.write(begin.encode())
                some = False
                for m in parts:
                    if m.rows:
                        out.write(between.encode() if some else b"")
                        some = True
                        with store.open_input_stream(m.name) as part:
                            while data := part.read(_CHUNK):
                                out.write(data)
                out.write(end.encode())
            store.move(whole, path)
        finally:
            self.abort(messages)

    def abort(self, messages: list) -> None:
        """All parts go, also those of tasks that failed or were lost; a task still at work has no folder to write to."""
        store, _ = _files(self.path)
        if store.get_file_info(self.beside).type.name != "NotFound":
            store.delete_dir(self.beside)


class OneFile(DataSource):
    @classmethod
    def name(cls) -> str:
        return "one_file"

    def schema(self) -> str:
        return "value string"

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(OneFile)


def save(df: DataFrame, path: str, kind: str = "array", limit: int = LIMIT) -> None:
    """Writes the rows in their order: one column to an array of values, several to one of objects, two to a map, one to a report."""
    register(df.sparkSession)
    df.write.format("one_file").option("path", path).option("kind", kind).option("limit", str(limit)).mode("overwrite").save()
