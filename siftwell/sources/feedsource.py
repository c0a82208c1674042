"""Feeds as a data source of Spark: ``spark.read.format("feeds").load(folder)`` and ``spark.readStream.format("feeds").load(folder)``.

A fetcher drops files of JSON lines (feed_url, xml) into a folder; each entry of a feed's document becomes a row of readers.FEED. The folder
may lie in any file system that pyarrow knows by its address, so that the driver lists it and tasks read it on their own.
Register the source once a session with ``spark.dataSource.register(FeedSource)``.

Options: ``filesPerPartition`` (16), ``filesPerBatch`` (1000; streams only) and ``settle`` (seconds, 2; streams only).
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from itertools import batched

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .readers import FEED, feed_items


class Files(InputPartition):
    """Some files of a folder, read by one task."""

    def __init__(self, paths: tuple[str, ...]):
        self.paths = paths


class _Folder:
    """The files of a folder as (time of the last change in nanoseconds, path), and the entries that files hold."""

    def __init__(self, options: dict):
        self.told = {k.lower(): v for k, v in options.items()}
        if not self.told.get("path"):
            raise ValueError("feeds need a folder: load(folder)")
        self.folder, self.each = self.told["path"], int(self.told.get("filesperpartition", 16))

    def _system(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.folder) if "://" in self.folder or self.folder.startswith("file:") else (fs.LocalFileSystem(), self.folder)

    def files(self) -> list[tuple[int, str]]:
        """In order; hidden ones and those that are still being written (a leading dot or underscore) don't count."""
        system, path = self._system()
        found = system.get_file_info(fs.FileSelector(path, allow_not_found=True, recursive=False))
        return sorted((x.mtime_ns or 0, x.path) for x in found if x.type == fs.FileType.File and not x.base_name.startswith((".", "_")))

    def split(self, files: list[tuple[int, str]]) -> list[Files]:
        return [Files(tuple(p for _, p in some)) for some in batched(files, self.each)]

    def read(self, partition: Files) -> Iterator[tuple]:
        """Rows of FEED. A line that isn't a JSON object gives none, nor does a document that can't be read. Lines are read one by one."""
        system, _ = self._system()
        for path in partition.paths:
            with system.open_input_stream(path) as raw:
                for line in _lines(raw):
                    try:
                        told = json.loads(line)
                    except ValueError:
                        continue
                    if isinstance(told, dict):
                        for i, (title, link, at) in enumerate(feed_items(told.get("xml"))):
                            yield told.get("feed_url"), i, title, link, at


def _lines(raw, size: int = 1 << 20) -> Iterator[bytes]:
    rest: list[bytes] = []
    while part := raw.read(size):
        *whole, last = part.split(b"\n")
        for line in whole:
            yield b"".join([*rest, line])
            rest = []
        rest.append(last)
    if any(rest):
        yield b"".join(rest)


class FeedReader(_Folder, DataSourceReader):
    """All files that lie in the folder."""

    def partitions(self) -> list[Files]:
        return self.split(self.files()) or [Files(())]


class FeedStreamReader(_Folder, DataSourceStreamReader):
    """Files in order of their last change and path. An offset is the last file that was taken, so a query that starts again from its
    checkpoint goes on behind it, and a batch that is repeated reads the same files.

    Files count once they haven't changed for ``settle`` seconds: one that comes later then never sorts before a file that was taken.
    """

    def __init__(self, options: dict):
        super().__init__(options)
        self.most, self.settle = int(self.told.get("filesperbatch", 1000)), float(self.told.get("settle", 2))
        self.taken: dict = {}

    def initialOffset(self) -> dict:
        return {"at": -1, "path": ""}

    def _between(self, start: dict, end: dict) -> list[tuple[int, str]]:
        return [f for f in self.files() if (start["at"], start["path"]) < f <= (end["at"], end["path"])]

    def latestOffset(self) -> dict:
        """At most ``filesPerBatch`` files on from the last offset that this reader gave."""
        last = self.taken or self.initialOffset()
        before = time.time_ns() - int(self.settle * 1e9)
        new = [f for f in self.files() if (last["at"], last["path"]) < f and f[0] <= before][: self.most]
        self.taken = {"at": new[-1][0], "path": new[-1][1]} if new else last
        return self.taken

    def partitions(self, start: dict, end: dict) -> list[Files]:
        self.taken = max(self.taken or end, end, key=lambda o: (o["at"], o["path"]))  # of a query that starts again
        return self.split(self._between(start, end)) or [Files(())]

    def commit(self, end: dict) -> None:
        """Files stay where they are."""


class FeedSource(DataSource):
    """Entries of feeds in a folder, in batches and streams."""

    @classmethod
    def name(cls) -> str:
        return "feeds"

    def schema(self) -> str:
        return FEED

    def reader(self, schema) -> FeedReader:
        return FeedReader(dict(self.options))

    def streamReader(self, schema) -> FeedStreamReader:
        return FeedStreamReader(dict(self.options))
