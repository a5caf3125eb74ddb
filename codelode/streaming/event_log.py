"""A log of events as a streaming source and sink: spark.readStream / writeStream.format("event_log").option("path", ...).

Each writer has a folder, in which a micro-batch is a manifest named by the batch's number and the files that it lists. A manifest is
renamed into place when its files are complete, and a batch that has one is not written again: after a crash Spark repeats the last
batch, and the log holds it once. A reader's offset is how many manifests of each writer it has read, so it neither skips nor repeats
one. The folder must be one that driver and executors can open.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, DataSourceStreamWriter, InputPartition, WriterCommitMessage
from pyspark.sql.streaming import StreamingQuery

SCHEMA = "writer string, batch long, value string"


def _manifests(folder: str) -> list[str]:
    return sorted(n for n in os.listdir(folder) if n.endswith(".json")) if os.path.isdir(folder) else []


@dataclass
class _Written(WriterCommitMessage):
    path: str
    rows: int


class _File(InputPartition):
    def __init__(self, writer: str, batch: int, path: str):
        self.writer, self.batch, self.path = writer, batch, path


class _Reader(DataSourceStreamReader):
    def __init__(self, root: str):
        self.root = root

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        names = sorted(os.listdir(self.root)) if os.path.isdir(self.root) else []
        return {w: n for w in names if (n := len(_manifests(os.path.join(self.root, w))))}

    def partitions(self, start: dict, end: dict) -> list[_File]:
        out = []
        for writer, n in sorted(end.items()):
            folder = os.path.join(self.root, writer)
            for name in _manifests(folder)[start.get(writer, 0) : n]:
                with open(os.path.join(folder, name)) as f:
                    out += [_File(writer, int(name[:-5]), os.path.join(folder, part)) for part in json.load(f)["files"]]
        return out

    def read(self, partition: _File) -> Iterator[tuple]:
        with open(partition.path, newline="\n", encoding="utf-8") as f:
            for line in f:
                yield partition.writer, partition.batch, line.rstrip("\n")

    def commit(self, end: dict) -> None:
        """The log keeps what was read: other readers may be behind."""


class _Writer(DataSourceStreamWriter):
    def __init__(self, root: str, writer: str):
        self.folder = os.path.join(root, writer)

    def write(self, rows: Iterator) -> _Written:
        os.makedirs(self.folder, exist_ok=True)
        path, n = os.path.join(self.folder, f"part-{uuid.uuid4().hex}"), 0
        with open(path, "w", encoding="utf-8", newline="\n") as f:
            for row in rows:
                f.write(json.dumps(json.loads(row["value"]), ensure_ascii=True) + "\n")  # one line, whatever white space the value had
                n += 1
        return _Written(path, n)

    def commit(self, messages: list, batchId: int) -> None:
        manifest = os.path.join(self.folder, f"{batchId:012d}.json")
        if os.path.exists(manifest):  # the batch was written before a crash
            self.abort(messages, batchId)
            return
        os.makedirs(self.folder, exist_ok=True)
        aside = f"{manifest}.{uuid.uuid4().hex}"
        with open(aside, "w") as f:
            json.dump({"files": [os.path.basename(m.path) for m in messages if m is not None and m.rows]}, f)
        os.replace(aside, manifest)

    def abort(self, messages: list, batchId: int) -> None:
        for m in messages:
            if m is not None and os.path.exists(m.path):
                os.remove(m.path)


class EventLog(DataSource):
    """Options: path, and for a sink writer, the name under which it adds to the log (one query a name, which keeps its checkpoint).

    A sink takes a column value of JSON; anything else fails the batch. A source gives writer, batch and value.
    """

    @classmethod
    def name(cls) -> str:
        return "event_log"

    def _root(self) -> str:
        return self.options["path"].removeprefix("file://")

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> _Reader:
        return _Reader(self._root())

    def streamWriter(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self._root(), self.options["writer"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(EventLog)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The events of a log as a stream, from its beginning."""
    register(spark)
    return spark.readStream.format("event_log").option("path", path).load()


def publish(events: DataFrame, path: str, writer: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Add a stream of events to a log, each as JSON of all its columns; every micro-batch once."""
    register(events.sparkSession)
    out = events.select(F.to_json(F.struct("*")).alias("value")).writeStream.format("event_log").option("path", path).option("writer", writer).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if available_now else out).start()
