"""Recorded responses as a data source: ``spark.read.format("recorded_responses")``, and as a stream."""

from __future__ import annotations

import io
import json
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "source string, request_id string, query_group string, observed_at date, response string, problem string, file string, line_no long"


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or not path.startswith("file:") else "file://" + path[5:])


def _files(path: str) -> list[tuple[int, str, int]]:
    """(time changed, name, bytes) of a folder's files, or of one file, in that order."""
    system, inner = _store(path)
    info = system.get_file_info(inner)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(inner, recursive=True))
    return sorted((f.mtime_ns or 0, f.path, f.size) for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")))


@dataclass
class Stretch(InputPartition):
    """The lines of a file that begin at ``start`` or after, and before ``end``."""

    name: str
    start: int
    end: int


def _stretches(files: list[tuple[int, str, int]], split: int) -> list[Stretch]:
    return [Stretch(name, at, min(at + split, size)) for _, name, size in files for at in range(0, size, split)]


def _read(path: str, stretch: Stretch, sources: frozenset[str] | None) -> Iterator[tuple]:
    """Rows of a stretch; what is no object of a source is a row with a problem, and nothing is dropped but by filter."""
    system, _ = _store(path)
    with io.BufferedReader(system.open_input_file(stretch.name), 1 << 20) as file:
        at = stretch.start
        if at:
            file.seek(at - 1)
            at += len(file.readline()) - 1  # a line that began before is another stretch's
        else:
            file.seek(0)
        while at < stretch.end:
            line = file.readline()
            if not line:
                return
            begun, at = at, at + len(line)
            text = line.decode("utf-8", "replace").strip()
            if not text:
                continue
            try:
                row = json.loads(text)
                day = date.fromisoformat(row["observed_at"][:10]) if row.get("observed_at") else None
                out = (row.get("source"), row.get("request_id"), row.get("query_group"), day, json.dumps(row.get("response"), ensure_ascii=False, separators=(",", ":")), None)
            except (ValueError, AttributeError, TypeError):
                out = (None, None, None, None, text, "not a response")
            if sources is None or out[0] in sources:
                yield (*out, stretch.name, begun)


class _Batch(DataSourceReader):
    def __init__(self, path: str, split: int) -> None:
        self.path, self.split, self.sources = path, split, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes conditions on the source, which are looked at before a row is made for Spark."""
        for f in filters:
            wanted = {f.value} if isinstance(f, EqualTo) and f.attribute == ("source",) else set(f.value) if isinstance(f, In) and f.attribute == ("source",) else None
            if wanted is None:
                yield f
            else:
                self.sources = frozenset(wanted if self.sources is None else self.sources & wanted)

    def partitions(self) -> list[Stretch]:
        return _stretches(_files(self.path), self.split) or [Stretch("", 0, 0)]

    def read(self, partition: Stretch) -> Iterator[tuple]:
        return _read(self.path, partition, self.sources) if partition.name else iter(())


class _Stream(DataSourceStreamReader):
    """Offsets are the place of the last file by (time changed, name): files are written once and whole."""

    def __init__(self, path: str, split: int) -> None:
        self.path, self.split = path, split

    def initialOffset(self) -> dict:
        return {"time": -1, "name": ""}

    def latestOffset(self) -> dict:
        files = _files(self.path)
        return {"time": files[-1][0], "name": files[-1][1]} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        after, upto = (start["time"], start["name"]), (end["time"], end["name"])
        return _stretches([f for f in _files(self.path) if after < f[:2] <= upto], self.split)

    def read(self, partition: Stretch) -> Iterator[tuple]:
        return _read(self.path, partition, None)


class RecordedResponses(DataSource):
    """Folders of JSON lines, each a response that was recorded with its source, request and day.

    Options: ``path``; ``split``, the bytes of a file that a task reads (64 MB). A file is read by
    as many tasks as it has such stretches; ``line_no`` is the byte at which the line begins. The
    store is any that pyarrow reaches by URI. As a stream, files that came after the last are read.
    """

    @classmethod
    def name(cls) -> str:
        return "recorded_responses"

    def schema(self) -> str:
        return SCHEMA

    def _options(self) -> tuple[str, int]:
        if "path" not in self.options:
            raise ValueError("recorded_responses needs a path")
        return self.options["path"], int(self.options.get("split", 64 << 20))

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Batch(*self._options())

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Stream(*self._options())


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, with filters pushed down to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RecordedResponses)
