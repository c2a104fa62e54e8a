"""A streaming source of numbered frames: what comes next is known from the offset, so no folder is listed.

A row names a frame and its place: (sequence, frame_id, gof_id, of_group, path), of_group being the frames that its group
will have where that is known. Contents are read by whoever takes the frames, with Spark's own readers. An offset is the number of
the next frame and whether the stream is at its end; so a batch that is read again has the same rows. When a stream of unknown
length ends within a group, one more row without a frame tells the frames of that group: nobody waits for more.

Options: pattern (with a %d), sequence (name; else what precedes the number), start (number of the first file), frames (files of a
pass; unknown if left out), loops (passes, 0: endless; needs frames), size (frames a group), limit (frames a batch; 0: all that
are there), wait (true: a file is taken only when it is there), end (a file whose presence says that no frame follows those
that are there; looked at only where frames is left out).
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

SCHEMA = "sequence string, frame_id long, gof_id long, of_group int, path string"
Row = tuple[str, int | None, int, int, str | None]
#: Frames that an endless stream without a limit gives a batch.
ENDLESS_BATCH = 64


def present(path: str) -> bool:
    """Whether a file is there; in a store that Arrow knows, else in the local one."""
    if "://" not in path and not path.startswith("file:"):
        return os.path.exists(path)
    import pyarrow.fs as fs

    store, at = fs.FileSystem.from_uri(path)
    return store.get_file_info(at).type != fs.FileType.NotFound


class FrameReader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.pattern = options["pattern"]
        self.sequence = options.get("sequence") or self.pattern.rsplit("/", 1)[-1].split("%")[0]
        self.start, self.size, self.limit = (int(options.get(k, d)) for k, d in (("start", "0"), ("size", "16"), ("limit", "0")))
        self.frames = int(options["frames"]) if options.get("frames") else None
        loops = int(options.get("loops", "1"))
        if self.frames is None and loops != 1:
            raise ValueError("loops need a number of frames")
        self.total = self.frames * loops if self.frames is not None and loops else None
        self.wait = options.get("wait", "false" if self.frames is not None else "true").lower() == "true"
        self.end = options.get("end")

    def path(self, n: int) -> str:
        return self.pattern % (self.start + (n % self.frames if self.frames else n))

    def initialOffset(self) -> dict:
        return {"frame": 0, "ended": self.total == 0}

    def read(self, start: dict) -> tuple[Iterator[Row], dict]:
        if start["ended"]:
            return iter([]), start
        at = start["frame"]
        closed = self.frames is None and self.end is not None and present(self.end)  # looked at before the files: none can come in between
        stop = self.total if self.total is not None else None
        limit = self.limit or (None if stop is not None or self.frames is None else ENDLESS_BATCH)
        if limit is not None:
            stop = at + limit if stop is None else min(stop, at + limit)
        n = at
        if self.wait:
            while (stop is None or n < stop) and present(self.path(n)):
                n += 1
        else:
            n = stop
        ended = n == self.total or (closed and (stop is None or n < stop))
        now = {"frame": n, "ended": bool(ended)}
        return self.readBetweenOffsets(start, now), now

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[Row]:
        rows: list[Row] = []
        for n in range(start["frame"], end["frame"]):
            group = n // self.size
            rows.append((self.sequence, n, group, self.size if self.total is None else min(self.size, self.total - group * self.size), self.path(n)))
        group, rest = divmod(end["frame"], self.size)
        if end["ended"] and not start["ended"] and self.total is None and rest:
            rows.append((self.sequence, None, group, rest, None))
        return iter(rows)


class FrameSource(DataSource):
    """spark.readStream.format("frames")"""

    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> str:
        return SCHEMA

    def simpleStreamReader(self, schema) -> FrameReader:
        return FrameReader(dict(self.options))


def frames(spark: SparkSession, pattern: str, **options: object):
    """The stream of a pattern's frames; options as above."""
    spark.dataSource.register(FrameSource)
    reader = spark.readStream.format("frames").option("pattern", pattern)
    for name, value in options.items():
        if value is not None:
            reader = reader.option(name, str(value).lower() if isinstance(value, bool) else str(value))
    return reader.load()
