"""Request logs as a data source: files of lines in folders by day, read in byte ranges, as a batch or a stream."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date
from urllib.parse import urlparse

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "day date, file string, start long, line string, bad binary"
#: Bytes of a partition, of a read, and of a batch of rows.
SPLIT, BLOCK, BATCH = 64 << 20, 1 << 20, 4 << 20
_ARROW = pa.schema([("day", pa.date32()), ("file", pa.string()), ("start", pa.int64()), ("line", pa.string()), ("bad", pa.binary())])
_TESTS = {
    EqualTo: lambda day, v: day == v, In: lambda day, v: day in v, GreaterThan: lambda day, v: day > v, GreaterThanOrEqual: lambda day, v: day >= v,
    LessThan: lambda day, v: day < v, LessThanOrEqual: lambda day, v: day <= v,
}


@dataclass
class Range(InputPartition):
    """The lines of a file that begin in [first, last); nothing past `end` is read."""

    file: str
    day: date | None
    first: int
    last: int
    end: int


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if urlparse(path).scheme else (pafs.LocalFileSystem(), path)


def _day(file: str) -> date | None:
    parts = [p[4:] for p in file.split("/")[:-1] if p.startswith("day=")]
    try:
        return date.fromisoformat(parts[-1]) if parts else None
    except ValueError:
        return None


def _files(fs: pafs.FileSystem, folder: str) -> dict[str, int]:
    """Sizes of the files under a folder; names that begin with _ or . are no logs."""
    found = fs.get_file_info(pafs.FileSelector(folder, recursive=True, allow_not_found=True))
    return {f.path: f.size for f in found if f.type == pafs.FileType.File and f.size and f.base_name[0] not in "_."}


def _ranges(file: str, first: int, end: int, split: int) -> list[Range]:
    return [Range(file, _day(file), a, min(a + split, end), end) for a in range(first, end, split)]


def _lines(fs: pafs.FileSystem, part: Range) -> Iterator[tuple[int, bytes]]:
    """(place, line) of the lines that begin in a range, the last of them to its end."""
    with fs.open_input_file(part.file) as f:
        # a line begins where a line feed is before it
        at = max(part.first - 1, 0)
        f.seek(at)
        skip, kept, start = part.first > 0, [], part.first
        while at < part.end:
            block = f.read(min(BLOCK, part.end - at))
            if not block:
                break
            pos = 0
            while (feed := block.find(b"\n", pos)) >= 0:
                if not skip:
                    yield start, b"".join([*kept, block[pos:feed]])
                skip, kept, pos, start = False, [], feed + 1, at + feed + 1
                if start >= part.last:
                    return
            if not skip:
                kept.append(block[pos:])
            at += len(block)
        if b"".join(kept):
            yield start, b"".join(kept)


def _batches(fs: pafs.FileSystem, part: Range) -> Iterator[pa.RecordBatch]:
    rows, size = [], 0
    for start, line in _lines(fs, part):
        line = line.removesuffix(b"\r")
        if not line:
            continue
        try:
            rows.append((part.day, part.file, start, line.decode(), None))
        except UnicodeDecodeError:
            rows.append((part.day, part.file, start, None, line))
        size += len(line) + 100
        if size > BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)
            rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)


class _Reader(DataSourceReader):
    def __init__(self, path: str, split: int):
        self.path, self.split, self.filters = path, split, []

    def partitions(self) -> list[Range]:
        fs, folder = _open(self.path)
        wanted = lambda day: all(day is not None and _TESTS[test](day, v) for test, v in self.filters)
        return [r for file, size in sorted(_files(fs, folder).items()) if wanted(_day(file)) for r in _ranges(file, 0, size, self.split)]

    def read(self, part: Range | None) -> Iterator[pa.RecordBatch]:
        return _batches(_open(self.path)[0], part) if part else iter(())


class _PrunedReader(_Reader):
    """Spark refuses a reader with this method where pushdown is off."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Conditions on the day choose files; Spark keeps the others."""
        for x in filters:
            if type(x) in _TESTS and x.attribute == ("day",):
                self.filters.append((type(x), x.value))
            else:
                yield x


class _StreamReader(DataSourceStreamReader):
    """An offset has each file's bytes up to its last line feed; a line is read once it is whole."""

    def __init__(self, path: str, split: int):
        self.path, self.split = path, split
        self.whole: dict[str, tuple[int, int]] = {}

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        fs, folder = _open(self.path)
        files = _files(fs, folder)
        # only files that have grown since the last look are opened
        self.whole = {f: self.whole[f] if self.whole.get(f, (-1,))[0] == size else (size, self._last_feed(fs, f, size)) for f, size in files.items()}
        return {"files": json.dumps({f: end for f, (_, end) in sorted(self.whole.items()) if end})}

    def _last_feed(self, fs: pafs.FileSystem, file: str, size: int) -> int:
        with fs.open_input_file(file) as f:
            while size:
                first = max(size - BLOCK, 0)
                f.seek(first)
                feed = f.read(size - first).rfind(b"\n")
                if feed >= 0:
                    return first + feed + 1
                size = first
        return 0

    def partitions(self, start: dict, end: dict) -> list[Range]:
        before, after = json.loads(start["files"]), json.loads(end["files"])
        return [r for file, size in after.items() for r in _ranges(file, before.get(file, 0), size, self.split)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        return _batches(_open(self.path)[0], part)


class RequestLogSource(DataSource):
    """format("request_log"): (day, file, start, line, bad) of the lines of all files under a folder.

    day is that of a folder day=YYYY-MM-DD above a file, else null; start is where the line
    begins. A line that is no UTF-8 is kept apart in bad, as bytes, and has no line. Empty
    lines are left out. A file is read in ranges of `split` bytes, a line where it begins.
    A stream takes what is appended to files and new files, and leaves a last line without
    its line feed until it is whole; a batch takes that too. With the option prune, which
    needs spark.sql.python.filterPushdown.enabled, conditions on day choose files. An offset
    has one entry a file; executors and driver must reach the path, which may be a URI.
    """

    @classmethod
    def name(cls) -> str:
        return "request_log"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        kind = _PrunedReader if self.options.get("prune") == "true" else _Reader
        return kind(self.options["path"], int(self.options.get("split", SPLIT)))

    def streamReader(self, schema) -> _StreamReader:
        return _StreamReader(self.options["path"], int(self.options.get("split", SPLIT)))


def request_log(spark: SparkSession, path: str, stream: bool = False, split: int = SPLIT) -> DataFrame:
    """The lines of a request log, for parse_request_log(.., json="line"); pruned by day where the session allows it."""
    spark.dataSource.register(RequestLogSource)
    prune = not stream and spark.conf.get("spark.sql.python.filterPushdown.enabled") == "true"
    reader = (spark.readStream if stream else spark.read).format("request_log").option("split", split)
    return reader.option("prune", prune).load(path)
