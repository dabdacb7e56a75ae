"""Files as tables: whole values, windows, and large files by byte ranges.

A file of any size is cut under the generic or the text profile without being in one task: ranges are hashed
apart, with the few bytes before each, and only the places where a cut may fall come together to be chosen
among, in order of place - about one in 16 KiB of input. Data itself is never shuffled. Under any other
profile a file goes window by window through `streaming.feed.chunk_windows`, whose state is bounded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from sediment.functions.gear import low_cuts
from sediment.functions.profiles import GENERIC, GENERIC_MASKS, MAX_CHUNK, TEXT, Rejected
from sediment.operators.content import check_utf8, text_cuts, text_end
from sediment.operators.cuts import next_cut

#: Bytes before a range that its hashes need.
LEAD = 63
CHUNKS = "path string, ordinal long, start long, end long, length long, error string"


def read_files(spark: SparkSession, path: str, pattern: str | None = None, in_order: bool = False) -> DataFrame:
    """(path, modificationTime, length, content): files below `path`; content isn't read unless it is used. in_order: sorted by path. Spark leaves empty files out; read_windows has them."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    out = reader.load(path)
    return out.orderBy("path") if in_order else out


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class RangePartition(InputPartition):
    def __init__(self, path: str, start: int, end: int, size: int) -> None:
        self.path, self.start, self.end, self.size = path, start, end, size


class RangeReader(DataSourceReader):
    """Files below a path in ranges of `rangebytes`."""

    def __init__(self, options: dict) -> None:
        self.path, self.step = options["path"], int(options.get("rangebytes", 64 << 20))

    def partitions(self) -> list[RangePartition]:
        from pyarrow import fs

        system, path = _store(self.path)
        info = system.get_file_info(path)
        found = [info] if info.type == fs.FileType.File else [f for f in system.get_file_info(fs.FileSelector(path, recursive=True)) if f.type == fs.FileType.File]
        return [RangePartition(f.path, a, min(a + self.step, f.size), f.size) for f in found for a in range(0, max(f.size, 1), self.step)]

    def bytes_of(self, partition: RangePartition, before: int, after: int) -> bytes:
        """The range with some bytes on either side, as far as the file has them."""
        system, _ = _store(self.path)
        with system.open_input_file(partition.path) as f:
            f.seek(max(0, partition.start - before))
            return f.read(min(partition.end + after, partition.size) - max(0, partition.start - before))


def range_fault(data: bytes, lead: int, start: int, end: int, size: int) -> Rejected | None:
    """What is wrong with the scalars that begin in [start, end) of a file; data begins `lead` bytes before and goes on for three, if the file does."""
    first = 0
    for back in range(1, min(3, lead) + 1):  # a scalar that began before the range is the range before's
        byte = data[lead - back]
        if byte >= 0xC0:
            first = max(0, (2 if byte < 0xE0 else 3 if byte < 0xF0 else 4) - back)
        if byte & 0xC0 != 0x80:
            break
    own, behind = data[lead + first : lead + end - start], data[lead + end - start :]
    try:
        upto = check_utf8(own, start + first, end == size)
        if upto < start + first + len(own):
            open_scalar = own[upto - start - first :]
            need = 2 if open_scalar[0] < 0xE0 else 3 if open_scalar[0] < 0xF0 else 4
            check_utf8((open_scalar + behind)[:need], upto)
    except Rejected as e:
        return e
    return None


class CandidateReader(RangeReader):
    def __init__(self, options: dict) -> None:
        super().__init__(options)
        self.profile = options.get("profile", GENERIC)

    def read(self, partition: RangePartition) -> Iterator[pa.RecordBatch]:
        data, lead = self.bytes_of(partition, LEAD, 3), min(LEAD, partition.start)
        body = np.frombuffer(data, np.uint8)[: lead + partition.end - partition.start]
        before = partition.start - lead
        fault = range_fault(data, lead, partition.start, partition.end, partition.size) if self.profile == TEXT else None
        if self.profile == TEXT:
            strict, relaxed = text_cuts(body, before)
        else:
            strict, relaxed = (c + before for c in low_cuts(body, GENERIC, GENERIC_MASKS))
        places = np.union1d(strict, relaxed)
        places = places[places > partition.start]
        # the row of the file's size keeps files without a candidate; a fault stands at its own place
        ends = [partition.size, *([fault.offset] if fault else [])]
        n = len(places) + len(ends)
        kinds = np.isin(places, strict) * 1 + np.isin(places, relaxed) * 2
        columns = [pa.array([partition.path] * n), pa.array([partition.size] * n, pa.int64()), pa.array([*places.tolist(), *ends], pa.int64())]
        columns += [pa.array([*kinds.tolist(), *([0] * len(ends))], pa.int32()), pa.array([None] * (n - 1) + [fault.detail if fault else None], pa.string())]
        yield pa.RecordBatch.from_arrays(columns, names=["path", "size", "place", "kind", "error"])


class CutCandidates(DataSource):
    """spark.read.format("cut_candidates").option("rangeBytes", n).option("profile", p).load(path) -> (path, size, place, kind, error).

    kind: 1 for a strict candidate, 2 for a relaxed one, 3 for both.
    """

    @classmethod
    def name(cls) -> str:
        return "cut_candidates"

    def schema(self) -> str:
        return "path string, size long, place long, kind int, error string"

    def reader(self, schema) -> CandidateReader:
        return CandidateReader({k.lower(): v for k, v in self.options.items()})


class Chooser:
    """Chunk ends of one file from its candidates in order of place; it holds those of the open chunk."""

    def __init__(self, path: str, size: int, profile: str, folder: str) -> None:
        self.path, self.size, self.profile, self.folder = path, size, profile, folder
        self.start, self.ordinal, self.known = 0, 0, 0
        self.strict = self.relaxed = np.empty(0, np.int64)

    def next_end(self) -> int:
        if self.profile == GENERIC:
            return next_cut(self.strict, self.relaxed, self.start, self.start)
        end = text_end(self.strict, self.relaxed, self.start)
        if end is not None:
            return end
        end = self.start + MAX_CHUNK
        if end < self.size and end <= self.known:
            system, _ = _store(self.folder)
            with system.open_input_file(self.path) as f:  # no cut inside a scalar
                f.seek(end - 3)
                around = f.read(4)
            end -= next(k for k in range(4) if around[3 - k] & 0xC0 != 0x80)
        return end

    def take(self, places: np.ndarray, kinds: np.ndarray) -> list[tuple]:
        self.strict = np.concatenate([self.strict[self.strict > self.start], places[kinds & 1 > 0]])
        self.relaxed = np.concatenate([self.relaxed[self.relaxed > self.start], places[kinds & 2 > 0]])
        self.known, out = int(places[-1]), []
        while self.start < self.size:
            end = min(self.next_end(), self.size)
            if end > self.known:
                break
            out.append((self.path, self.ordinal, self.start, end, end - self.start, None))
            self.ordinal, self.start = self.ordinal + 1, end
        return out


def file_ranges(spark: SparkSession, path: str, range_bytes: int = 64 << 20, profile: str = GENERIC) -> DataFrame:
    """(path, ordinal, start, end, length, error) of files under the generic or the text profile, each read in ranges by many tasks.

    A file that isn't UTF-8 has one row with the error under the text profile. An empty file has no row.
    """
    if profile not in (GENERIC, TEXT):
        raise ValueError(f"{profile} reads a file from its start; feed it in windows")
    spark.dataSource.register(CutCandidates)
    found = spark.read.format("cut_candidates").option("rangeBytes", str(range_bytes)).option("profile", profile).load(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chooser, refused = None, None
        for batch in batches:
            paths, sizes, errors = (batch.column(k).to_pylist() for k in (0, 1, 4))
            places, kinds = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            rows: list[tuple] = []
            cuts = [0, *(i for i in range(1, len(paths)) if paths[i] != paths[i - 1]), len(paths)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if errors[a] is not None and paths[a] != refused:
                    refused = paths[a]
                    rows.append((refused, None, None, None, None, errors[a]))
                if paths[a] == refused:
                    continue
                if chooser is None or chooser.path != paths[a]:
                    chooser = Chooser(paths[a], sizes[a], profile, path)
                rows += chooser.take(places[a:b], kinds[a:b])
            types = [pa.string(), *[pa.int64()] * 4, pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=["path", "ordinal", "start", "end", "length", "error"])

    # a file's faults come first, then its candidates by place
    return found.repartition("path").sortWithinPartitions("path", F.col("error").isNull(), "place").mapInArrow(run, CHUNKS)


def generic_ranges(spark: SparkSession, path: str, range_bytes: int = 64 << 20) -> DataFrame:
    return file_ranges(spark, path, range_bytes).drop("error")


class WindowReader(RangeReader):
    def __init__(self, options: dict) -> None:
        self.window = int(options.get("windowbytes", 1 << 20))
        super().__init__(options | {"rangebytes": str(max(1, int(options.get("rangebytes", 64 << 20)) // self.window) * self.window)})

    def read(self, partition: RangePartition) -> Iterator[pa.RecordBatch]:
        system, _ = _store(self.path)
        with system.open_input_file(partition.path) as f:
            f.seek(partition.start)
            for at in range(partition.start, max(partition.end, 1), self.window):
                data = f.read(min(self.window, partition.end - at))
                columns = [pa.array([partition.path]), pa.array([at // self.window], pa.int64()), pa.array([data], pa.binary()), pa.array([at + self.window >= partition.size])]
                yield pa.RecordBatch.from_arrays(columns, names=["stream_id", "seq", "window", "is_last"])


class FileWindows(DataSource):
    """spark.read.format("file_windows").option("windowBytes", n).load(path) -> (stream_id, seq, window, is_last): files of any size, for chunk_windows."""

    @classmethod
    def name(cls) -> str:
        return "file_windows"

    def schema(self) -> str:
        return "stream_id string, seq long, window binary, is_last boolean"

    def reader(self, schema) -> WindowReader:
        return WindowReader({k.lower(): v for k, v in self.options.items()})


def read_windows(spark: SparkSession, path: str, window_bytes: int = 1 << 20) -> DataFrame:
    """Files below `path` as windows, under their paths; a file may be of any size."""
    spark.dataSource.register(FileWindows)
    return spark.read.format("file_windows").option("windowBytes", str(window_bytes)).load(path)


def prefixes(files: DataFrame, content: str = "content") -> DataFrame:
    """files with the first 512 bytes in place of the content."""
    return files.withColumn(content, F.substring(F.col(f"`{content}`"), 1, 512))
