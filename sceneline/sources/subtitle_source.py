"""A Python data source for subtitle files: ``spark.read.format("subtitle").load(path)``.

Each file is a partition.  Files must be on a file system that the executors
mount; for other stores read whole texts with Spark and use
:func:`sceneline.operators.subtitles.cues`.
"""

from __future__ import annotations

import glob
import os
import re

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_TIME = re.compile(r"^\s*((?:\d+:)?\d{1,2}:\d{2}[.,]\d{1,3})\s*-->\s*((?:\d+:)?\d{1,2}:\d{2}[.,]\d{1,3})")


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


def _seconds(text: str) -> float:
    parts = [float(p) for p in text.replace(",", ".").split(":")]
    return sum(p * 60**i for i, p in enumerate(reversed(parts)))


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path.removeprefix("file://")

    def partitions(self):
        found = [self.path] if os.path.isfile(self.path) else sorted(p for e in ("srt", "vtt") for p in glob.glob(os.path.join(self.path, "**", f"*.{e}"), recursive=True))
        return [_File(p) for p in found]

    def read(self, partition):
        if not isinstance(partition, _File):
            return
        cue, times, body = 0, None, []
        with open(partition.path, encoding="utf-8-sig", errors="replace") as lines:
            for line in [*lines, "\n"]:
                m = _TIME.match(line)
                if (m or not line.strip()) and times:
                    yield (partition.path, cue, *times, "\n".join(body))
                    cue, times, body = cue + 1, None, []
                if m:
                    times = (_seconds(m[1]), _seconds(m[2]))
                elif times and line.strip():
                    body.append(line.strip())


class SubtitleSource(DataSource):
    """path, cue, start_sec, end_sec, original_text of SRT and WebVTT files."""

    @classmethod
    def name(cls):
        return "subtitle"

    def schema(self):
        return "path string, cue int, start_sec double, end_sec double, original_text string"

    def reader(self, schema):
        return _Reader(self.options["path"])


def register(spark) -> None:
    spark.dataSource.register(SubtitleSource)
