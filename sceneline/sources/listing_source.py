"""A Python data source for file listings: ``spark.read.format("listing").load(root)``.

A task lists some of the root's folders, so a listing grows with the cluster.
Filters on ``folder`` and ``extension`` (equality and membership) reach the
listing: other folders are not opened, other files are not looked at.  Hidden
files and folders are left out.  The root must be on a file system that the
driver and the executors mount; for other stores take
:func:`sceneline.sources.files.listing`.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from datetime import UTC, datetime

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

FOLDERS_PER_TASK = 64


class Folders(InputPartition):
    """Some folders of the root; the empty name stands for the files beside them."""

    def __init__(self, names: list[str]):
        self.names = names


def _shown(entries: Iterator[os.DirEntry]) -> list[os.DirEntry]:
    return sorted((e for e in entries if not e.name.startswith(".")), key=lambda e: e.name)


def extension(name: str) -> str:
    """Lower case, without the dot; a name that only begins with a dot, or ends with one, has none."""
    stem, dot, ext = name.rpartition(".")
    return ext.lower() if dot and stem else ""


class ListingReader(DataSourceReader):
    def __init__(self, root: str, per_task: int):
        self.root, self.per_task = root.removeprefix("file://").rstrip("/") or "/", per_task
        self.wanted: dict[str, set[str]] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes tests of folder and extension for good; Spark keeps the others."""
        for f in filters:
            column = f.attribute[0] if isinstance(f, EqualTo | In) and len(f.attribute) == 1 else None
            if column in ("folder", "extension"):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted[column] = self.wanted.get(column, values) & values
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        with os.scandir(self.root) as entries:
            names = ["", *(e.name for e in _shown(entries) if e.is_dir(follow_symlinks=False))]
        if "folder" in self.wanted:
            names = [n for n in names if n in self.wanted["folder"]]
        return [Folders(names[i : i + self.per_task]) for i in range(0, len(names), self.per_task)] or [Folders([])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if not isinstance(partition, Folders):
            return
        for folder in partition.names:
            yield from self.walk(folder, os.path.join(self.root, folder) if folder else self.root)

    def walk(self, folder: str, path: str) -> Iterator[tuple]:
        left = [path]
        while left:
            try:
                with os.scandir(left.pop()) as entries:
                    found = _shown(entries)
            except FileNotFoundError:  # removed since the listing began
                continue
            for e in found:
                if e.is_dir(follow_symlinks=False):
                    if folder:
                        left.append(e.path)
                    continue
                ext = extension(e.name)
                if "extension" in self.wanted and ext not in self.wanted["extension"]:
                    continue
                try:
                    info = e.stat()
                except FileNotFoundError:
                    continue
                yield (folder, os.path.relpath(e.path, self.root), e.name, ext, info.st_size, datetime.fromtimestamp(info.st_mtime, UTC))


class ListingSource(DataSource):
    """folder (below the root, empty for files in it), relpath, name, extension, size, modified of all files."""

    @classmethod
    def name(cls) -> str:
        return "listing"

    def schema(self) -> str:
        return "folder string, relpath string, name string, extension string, size long, modified timestamp"

    def reader(self, schema) -> ListingReader:
        return ListingReader(self.options["path"], int(self.options.get("foldersPerTask", FOLDERS_PER_TASK)))


def register(spark) -> None:
    """Makes the format known; filters reach Python sources only with the setting that this turns on."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ListingSource)
