"""Recordings as folders of uncompressed frames, one frame a second, that are written and read in chunks of seconds.

A chunk is a file `<movie>/<first>-<end>.frames` (seconds, end exclusive): magic, width, height and number of frames, the seconds of
the frames in order, then their pixels. A read has a partition for each chunk; filters on movie_url and second take chunks out by
their names, and what is left of the seconds is read by seeking, so that no other frame is touched. Files are reached through Arrow's file
systems (local, HDFS, object stores).
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceWriter, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage,
)

SCHEMA = "movie_url string, second int, width int, height int, grey array<int>"
HEAD = struct.Struct("<4sIII")
MAGIC = b"GREY"
NULL_MOVIE = "%00"
#: Frames of a chunk that are handed on together.
BATCH = 64


def _opened(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


@dataclass
class Chunk(InputPartition):
    path: str
    movie: str | None
    first: int
    end: int


@dataclass
class Written(WriterCommitMessage):
    files: list


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.low, self.high, self.movies = path, 0, 1 << 31, None

    def pushFilters(self, filters) -> Iterator:
        """Takes over ranges of seconds and names of movies; all others come back to Spark."""
        for f in filters:
            name = getattr(f, "attribute", None)
            if name == ("second",) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.low = max(self.low, f.value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.high = min(self.high, f.value + (not isinstance(f, LessThan)))
            elif name == ("movie_url",) and isinstance(f, (EqualTo, In)):
                own = set(f.value if isinstance(f, In) else [f.value])
                self.movies = own if self.movies is None else self.movies & own
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        files, root = _opened(self.path)
        out = []
        for info in files.get_file_info(fs.FileSelector(root, allow_not_found=True, recursive=True)):
            name = info.path.rsplit("/", 2)
            if info.is_file and name[-1].endswith(".frames") and not name[-1].startswith("."):
                movie = None if name[-2] == NULL_MOVIE else unquote(name[-2])
                first, end = map(int, name[-1][: -len(".frames")].split("-")[:2])
                if first < self.high and end > self.low and (self.movies is None or movie in self.movies):
                    out.append(Chunk(info.path, movie, first, end))
        return sorted(out, key=lambda c: (c.movie or "", c.first)) or [Chunk("", None, 0, 0)]

    def read(self, chunk: Chunk) -> Iterator[pa.RecordBatch]:
        if not chunk.path:
            return
        files, _ = _opened(self.path)
        with files.open_input_file(chunk.path) as f:
            magic, width, height, n = HEAD.unpack(f.read(HEAD.size))
            if magic != MAGIC:
                raise ValueError(f"{chunk.path} holds no frames")
            seconds = np.frombuffer(f.read(4 * n), "<u4")
            wanted = np.flatnonzero((seconds >= self.low) & (seconds < self.high))
            for a in range(0, len(wanted), BATCH):
                own = wanted[a : a + BATCH]
                pixels = []
                for k in own.tolist():
                    f.seek(HEAD.size + 4 * n + k * width * height)
                    pixels.append(np.frombuffer(f.read(width * height), np.uint8))
                flat = pa.array(np.concatenate(pixels).astype(np.int32)) if pixels else pa.nulls(0, pa.int32())
                grey = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1) * width * height, pa.int32()), flat)
                m = len(own)
                cols = [pa.array([chunk.movie] * m, pa.string()), pa.array(seconds[own].astype(np.int32)), pa.array([width] * m, pa.int32()), pa.array([height] * m, pa.int32()), grey]
                yield pa.RecordBatch.from_arrays(cols, names=["movie_url", "second", "width", "height", "grey"])


class _Writer(DataSourceWriter):
    """Rows come sorted by movie and second, the chunks of a task one after the other. Files get their names when all are written."""

    def __init__(self, path: str, chunk: int):
        self.path, self.chunk = path, chunk

    def write(self, rows) -> Written:
        done, key, own = [], None, []
        for r in rows:
            now = (r.movie_url, r.second // self.chunk, r.width, r.height)
            if now != key:
                done += self._file(key, own)
                key, own = now, []
            own.append((r.second, bytes(r.grey)))
        return Written(done + self._file(key, own))

    def _file(self, key, frames) -> list[tuple[str, str]]:
        if not frames:
            return []
        movie, number, width, height = key
        files, root = _opened(self.path)
        folder = f"{root}/{NULL_MOVIE if movie is None else quote(movie, safe='') or '%01'}"
        name = f"{number * self.chunk}-{(number + 1) * self.chunk}-{width}x{height}.frames"
        files.create_dir(folder)
        part = f"{folder}/.{uuid.uuid4().hex}"
        with files.open_output_stream(part) as f:
            f.write(HEAD.pack(MAGIC, width, height, len(frames)) + np.array([s for s, _ in frames], "<u4").tobytes())
            for _, grey in frames:
                f.write(grey)
        return [(part, f"{folder}/{name}")]

    def commit(self, messages) -> None:
        files, _ = _opened(self.path)
        for m in messages:
            for part, name in m.files if m else ():
                files.move(part, name)

    def abort(self, messages) -> None:
        files, _ = _opened(self.path)
        for m in messages:
            for part, _ in m.files if m else ():
                files.delete_file(part)


class Recordings(DataSource):
    @classmethod
    def name(cls) -> str:
        return "recordings"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], int(self.options.get("chunk", "60")))


def write_recordings(frames: DataFrame, path: str, chunk: int = 60) -> None:
    """Write frames (movie_url, second, width, height, grey) in chunks of so many seconds; chunks that are there already are replaced.

    Frames without a second (or a negative one), without pixels or whose pixels aren't width * height are left out; of several frames
    of a movie's second the smallest counts. Null movies are a movie of their own.
    """
    spark = frames.sparkSession
    spark.dataSource.register(Recordings)
    one = frames.where("second >= 0 and grey is not null and size(grey) = width * height and width > 0").groupBy("movie_url", "second").agg(F.min(F.struct("width", "height", "grey")).alias("f"))
    rows = one.select("movie_url", F.col("second").cast("int").alias("second"), F.col("f.width").cast("int").alias("width"), F.col("f.height").cast("int").alias("height"), F.col("f.grey").cast("array<int>").alias("grey"))
    part = F.expr(f"second div {chunk}")
    rows = rows.repartition("movie_url", part).sortWithinPartitions("movie_url", part, "width", "height", "second")
    rows.write.format("recordings").option("path", path).option("chunk", str(chunk)).mode("append").save()


def read_recordings(spark: SparkSession, path: str) -> DataFrame:
    """Frames of all recordings in a folder (movie_url, second, width, height, grey); a folder that isn't there has none. Filters on
    second and movie_url reach the source."""
    spark.dataSource.register(Recordings)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("recordings").option("path", path).load()
