"""Queue files as a stream: a Python data source that reads each file once, and keeps bad tasks apart."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "file string, id string, url string, status string, priority int, retry_count int, problem string"


@dataclass
class Files(InputPartition):
    paths: tuple[str, ...]

    def __init__(self, paths):
        super().__init__(0)
        self.paths = tuple(paths)


def _number(x) -> int:
    return int(x) if isinstance(x, (int, float)) and not isinstance(x, bool) and abs(x) < 2**31 else 0


def _text(x) -> str | None:
    return None if x is None else x if isinstance(x, str) else json.dumps(x)


def tasks_of(name: str, text: str) -> Iterator[tuple]:
    """The tasks of a queue file, {"tasks": {key: task}}. A task without id or URL, or a file that is none, has a problem."""
    try:
        tasks = json.loads(text)["tasks"].items()
    except (ValueError, KeyError, TypeError, AttributeError) as e:
        yield name, None, None, None, None, None, f"no queue: {type(e).__name__}"
        return
    for key, t in tasks:
        if not isinstance(t, dict):
            yield name, key, None, None, None, None, "no task"
            continue
        lacks = [c for c in ("id", "url") if not t.get(c)]
        problem = f"no {' and no '.join(lacks)}" if lacks else None
        status = _text(t.get("status")) or "queued"
        yield name, _text(t.get("id")) or key, _text(t.get("url")), status, _number(t.get("priority")), _number(t.get("retry_count")), problem


class QueueStream(DataSourceStreamReader):
    """Offsets are the time and name of the last file read; files must not change once they are there, and later files
    have later times. A batch's files are dealt to tasks by size."""

    def __init__(self, path: str, partition_bytes: int):
        self.path, self.partition_bytes = path, partition_bytes

    def _files(self) -> list[tuple[int, str, int]]:
        fs, root = pafs.FileSystem.from_uri(self.path)
        found = fs.get_file_info(pafs.FileSelector(root, recursive=False, allow_not_found=True))
        return sorted((x.mtime_ns, x.path, x.size) for x in found if x.type == pafs.FileType.File and not x.base_name.startswith(("_", ".")))

    def initialOffset(self) -> dict:
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:
        files = self._files()
        return {"time": files[-1][0], "path": files[-1][1]} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict):
        low, high = ((x["time"], x["path"]) for x in (start, end))
        out, now, size = [], [], 0
        for time, path, n in self._files():
            if low < (time, path) <= high:
                if now and size + n > self.partition_bytes:
                    out.append(Files(now))
                    now, size = [], 0
                now.append(path)
                size += n
        return [*out, Files(now)] if now else out

    def read(self, partition: Files) -> Iterator[tuple]:
        fs, _ = pafs.FileSystem.from_uri(self.path)
        for path in partition.paths:
            with fs.open_input_file(path) as file:
                yield from tasks_of(path.rpartition("/")[2], file.read().decode("utf-8", "replace"))


class QueueSource(DataSource):
    """Options: path (a folder, as a URI), partition_bytes."""

    @classmethod
    def name(cls):
        return "task_queue"

    def schema(self):
        return SCHEMA

    def streamReader(self, schema):
        return QueueStream(self.options["path"], int(self.options.get("partition_bytes", 32 << 20)))


def queue_stream(spark: SparkSession, path: str):
    """A stream of the tasks of all queue files in a folder, and of those that come."""
    spark.dataSource.register(QueueSource)
    return spark.readStream.format("task_queue").option("path", path).load()
