"""Photo folders as a Spark data source: ``spark.read.format("photo_folder").option("path", ...)``, and as a stream of new files.

Folders are read through pyarrow's file systems, by URI or mounted path. The driver lists the first levels
only, until there are ``branches`` folders to deal out; each partition walks its own branches, so
no process holds the list of all files. Filters on ``extension`` and ``branch`` (the first folder below the path) are taken over by the
reader: branches that can't match aren't listed. A file that is empty or doesn't begin like
a picture of its extension is a row with the reason in ``error``; raw files aren't opened.

Options: ``path``; ``extensions`` (comma-joined, without points, any case; photos by default); ``excluded`` (folder
names that are skipped at any depth); ``branches`` (partitions, about); ``check`` (``false``: contents aren't opened).

The stream's offset is a time of modification: a micro-batch has the files changed after the last offset, up to a second before
now, so a file that is written within that second comes with the next batch. A file that is moved in with an older time isn't seen.
"""

from __future__ import annotations

import time
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition

from .. import vocab as V

SCHEMA = "path string, filename string, branch string, extension string, file_size_mb double, mtime double, error string"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
KINDS = (pa.string(),) * 4 + (pa.float64(),) * 2 + (pa.string(),)

#: What files of an extension begin with; others aren't looked at.
MAGIC = {"jpg": (b"\xff\xd8\xff",), "jpeg": (b"\xff\xd8\xff",), "png": (b"\x89PNG\r\n\x1a\n",), "webp": (b"RIFF",)}

#: Rows of an Arrow batch.
ROWS = 4096


@dataclass
class Branches(InputPartition):
    """Folders that are walked with everything below, and folders of which only the files are read."""

    deep: list[str]
    flat: list[str]
    after: float = -1.0
    until: float = float("inf")


class Walk:
    """What the batch and the stream reader share."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"].rstrip("/")
        listed = lambda name, default: [x.strip() for x in options.get(name, default).split(",") if x.strip()]
        self.extensions = {x.lower().lstrip(".") for x in listed("extensions", ",".join(V.PHOTO_EXTENSIONS))}
        self.excluded = set(listed("excluded", ""))
        self.branches = int(options.get("branches", "64"))
        self.check = options.get("check", "true").lower() != "false"
        self.only: set[str] | None = None  # names of branches that filters leave

    def open(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)

    def dealt(self) -> list[Branches]:
        store, top = self.open()
        flat, level = [top], [top]
        deep: list[str] = []
        while level:
            below = [x.path for f in level for x in store.get_file_info(fs.FileSelector(f)) if x.type == fs.FileType.Directory and x.base_name not in self.excluded and (f != top or self.only is None or x.base_name in self.only)]
            if len(below) >= self.branches or not below:
                deep = below
                break
            flat, level = flat + below, below
        parts = min(self.branches, max(1, len(deep) + len(flat)))
        flat.sort(), deep.sort()
        return [Branches(deep[n::parts], flat[n::parts]) for n in range(parts)]

    def rows(self, part: Branches) -> Iterator[pa.RecordBatch]:
        store, top = self.open()
        held: list[tuple] = []
        todo = [(f, False) for f in part.flat] + [(f, True) for f in part.deep]
        while todo:
            folder, deep = todo.pop()
            for x in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
                if x.type == fs.FileType.Directory and deep and x.base_name not in self.excluded:
                    todo.append((x.path, True))
                elif x.type == fs.FileType.File and (row := self._row(store, top, x, part)):
                    held.append(row)
                    if len(held) == ROWS:
                        yield self._batch(held)
                        held = []
        if held:
            yield self._batch(held)

    def _row(self, store: fs.FileSystem, top: str, x: fs.FileInfo, part: Branches) -> tuple | None:
        extension = x.extension.lower()
        if extension not in self.extensions:
            return None
        below = x.path[len(top) :].strip("/").split("/")
        branch = below[0] if len(below) > 1 else ""
        mtime = x.mtime_ns / 1e9 if x.mtime_ns else 0.0
        if self.only is not None and branch not in self.only or not part.after < mtime <= part.until:
            return None
        return x.path, x.base_name, branch, extension, round(x.size / 1048576, 2), mtime, self._error(store, x, extension)

    def _error(self, store: fs.FileSystem, x: fs.FileInfo, extension: str) -> str | None:
        if not x.size:
            return "empty"
        if not self.check or extension not in MAGIC:
            return None
        try:
            with store.open_input_stream(x.path) as f:
                begin = f.read(16)
        except OSError as e:
            return f"unreadable: {type(e).__name__}"
        return None if begin.startswith(MAGIC[extension]) and (extension != "webp" or begin[8:12] == b"WEBP") else "no picture"

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(KINDS)], NAMES)


class PhotoFolder(DataSource):
    @classmethod
    def name(cls) -> str:
        return "photo_folder"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return FolderReader(Walk(dict(self.options)))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return FolderStream(Walk(dict(self.options)))


class FolderReader(DataSourceReader):
    def __init__(self, walk: Walk):
        self.walk = walk

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is not None and f.attribute == ("extension",):
                self.walk.extensions &= values
            elif values is not None and f.attribute == ("branch",):
                self.walk.only = values if self.walk.only is None else self.walk.only & values
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        return self.walk.dealt()

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        return self.walk.rows(partition)


class FolderStream(DataSourceStreamReader):
    def __init__(self, walk: Walk):
        self.walk = walk

    def initialOffset(self) -> dict:
        return {"changed": -1.0}

    def latestOffset(self) -> dict:
        return {"changed": time.time() - 1}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        out = self.walk.dealt()
        for part in out:
            part.after, part.until = start["changed"], end["changed"]
        return out

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        return self.walk.rows(partition)

    def commit(self, end: dict) -> None:
        pass


def register(spark: SparkSession) -> None:
    """Makes the format known to the session, and lets it take filters over."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PhotoFolder)
