"""Instrument files as Spark formats, for tables and streams: ``plate_export`` and ``protocol``.

``spark.read.format("plate_export").load(path)`` gives the lines of wells with the line of labels of their
file; ``plate_export.readings_of_lines`` makes readings of them with column expressions. An export is read
by ranges of bytes, each a line at a time, so neither a file nor its lines are held as a whole, and small
files share a task. ``protocol`` gives the lines of sections as ``protocol.sections`` does; what a file
says last under a title counts, so its file is gone through twice, within one task.

Options: ``path`` (a folder or a file), ``pathGlobFilter`` (of file names), ``maxBytes`` (of a task),
``errors``: ``fail``, or ``rows`` for a row with ``error`` in place of a failure; for streams ``settle``,
the seconds that a file must have been left alone before it is taken.

A stream takes files in the order of (time of change, path), and its offset is the last one taken. A file
that comes in with an older time than that is never seen: files must be written or renamed into the
folder when they are complete, and ``settle`` must cover how far the clocks of writers differ.
"""

from __future__ import annotations

import fnmatch
import re
import time
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from auxograph.sources.plate_export import HEADER
from auxograph.sources.protocol import is_title, stripped, title_of

#: Bytes of files that a task reads, and what opening a file counts for.
TASK_BYTES = 128 << 20
OPEN_BYTES = 1 << 20
BLOCK_BYTES = 1 << 20
BATCH_LINES = 10_000

_END = re.compile(rb"\r\n|\r|\n")


class Pack(InputPartition):
    """What a task reads: (path, start, end) of each of its files."""

    def __init__(self, ranges: list[tuple[str, int, int]]):
        self.ranges = ranges


def _store(uri: str) -> tuple[fs.FileSystem, str, str]:
    """The file system of a path, the path in it, and what stands before paths in it."""
    files, path = fs.FileSystem.from_uri(uri if "://" in uri else re.sub("^[a-z0-9]+:/*", "/", uri))
    parts = urlsplit(uri)
    if isinstance(files, fs.LocalFileSystem):
        return files, path, "file:"
    return files, path, f"{parts.scheme}://{parts.netloc if path.startswith('/') else ''}"


def listed(options: dict) -> list[tuple[int, str, int]]:
    """(time of change in ns, path, size) of the files under ``path``, in that order; hidden ones are left out."""
    files, root, _ = _store(options["path"])
    top = files.get_file_info(root)
    found = [top] if top.is_file else files.get_file_info(fs.FileSelector(root, recursive=True))
    glob = options.get("pathGlobFilter")
    kept = []
    for f in found:
        below = f.path[len(root) :].strip("/") if not top.is_file else ""
        hidden = any(x[:1] in "._" and "=" not in x for x in below.split("/") if x)
        if f.is_file and not hidden and (not glob or fnmatch.fnmatchcase(f.base_name, glob)):
            kept.append((f.mtime_ns or 0, f.path, f.size))
    return sorted(kept)


def packed(files: list[tuple[int, str, int]], most: int, whole: bool) -> list[Pack]:
    """Files cut into ranges of at most ``most`` bytes (not if ``whole``), small ones put together."""
    packs: list[Pack] = []
    ranges: list[tuple[str, int, int]] = []
    held = 0
    for _, path, size in files:
        for start in [0] if whole else range(0, max(size, 1), most):
            end = size if whole else min(start + most, size)
            if ranges and held + end - start + OPEN_BYTES > most:
                packs.append(Pack(ranges))
                ranges, held = [], 0
            ranges.append((path, start, end))
            held += end - start + OPEN_BYTES
    return [*packs, Pack(ranges)] if ranges else packs


def lines(f, start: int, end: int, block: int = BLOCK_BYTES) -> Iterator[tuple[int, bytes]]:
    """(position, line) of the lines that begin at ``start`` or after it, and before ``end``.

    A line ends with a line feed, a carriage return, or both; the byte before ``start`` tells whether a
    line begins there.
    """
    at = max(start - 1, 0)
    f.seek(at)
    rest, over = b"", False
    while not over:
        new = f.read(block)
        over = not new
        rest += new
        done = 0
        for m in _END.finditer(rest):
            if m.end() == len(rest) and m.group() == b"\r" and not over:
                break  # the line feed may be in the next block
            if at + done >= end:
                return
            if at + done >= start:
                yield at + done, rest[done : m.start()]
            done = m.end()
        at, rest = at + done, rest[done:]
    if rest and start <= at < end:
        yield at, rest


def _text(line: bytes) -> str:
    return line.decode("utf-8", "replace")


def _head(f, size: int) -> tuple[int, str] | None:
    """Where the line of labels begins and what it says, ("", at the end) if there is none; None without a header."""
    headed = False
    for at, line in lines(f, 0, size):
        said = _text(line)
        if not said.strip(" "):
            continue
        if headed:
            return at, said
        headed = said.strip(" ").startswith(HEADER)
    return (size, "") if headed else None


class _Reader:
    """Rows of packs in Arrow batches; subclasses say what the rows of a range are."""

    def __init__(self, options: dict):
        self.options = {k: options[k] for k in ("path", "pathGlobFilter", "maxBytes", "errors", "settle") if k in options}
        if "path" not in self.options:
            raise ValueError("a path is needed")
        if self.options.get("errors", "fail") not in ("fail", "rows"):
            raise ValueError("errors must be fail or rows")

    fields: pa.Schema
    whole = False

    def rows(self, f, name: str, size: int, start: int, end: int) -> Iterator[tuple]:
        raise NotImplementedError

    def packs(self, files: list[tuple[int, str, int]]) -> list[Pack]:
        return packed(files, int(self.options.get("maxBytes", TASK_BYTES)), self.whole)

    def wrong(self, text: str, name: str) -> tuple:
        if self.options.get("errors", "fail") == "fail":
            raise ValueError(f"{text} in {name}")
        return (name, *[None] * (len(self.fields) - 2), text)

    def read(self, partition: Pack) -> Iterator[pa.RecordBatch]:
        files, _, before = _store(self.options["path"])
        held: list[tuple] = []
        for path, start, end in partition.ranges:
            name = before + quote(path, safe="/=:@!$&'()*+,;~-._")
            with files.open_input_file(path) as f:
                for row in self.rows(f, name, f.size(), start, end):
                    held.append(row)
                    if len(held) == BATCH_LINES:
                        yield self.batch(held)
                        held = []
        if held:
            yield self.batch(held)

    def batch(self, rows: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array(c, t.type) for c, t in zip(zip(*rows), self.fields)]
        return pa.RecordBatch.from_arrays(columns, schema=self.fields)


class _Plates(_Reader):
    fields = pa.schema([(n, pa.string()) for n in ("source_file", "labels", "line", "error")])

    def rows(self, f, name, size, start, end):
        head = _head(f, size)
        if head is None:
            if start == 0:
                yield self.wrong(f"no line starts with '{HEADER}'", name)
            return
        for at, line in lines(f, start, end):
            if at > head[0] and (said := _text(line)).strip(" "):
                yield name, head[1], said, None


class _Protocols(_Reader):
    fields = pa.schema(
        [("source_file", pa.string()), ("title", pa.string()), ("section", pa.int64()), ("line_no", pa.int32()), ("line", pa.string()), ("error", pa.string())]
    )
    whole = True

    def rows(self, f, name, size, start, end):
        last: dict[str | None, int] = {}
        for title, section, _, _ in self._titled(f, size):
            last[title] = section
        if not last:
            yield self.wrong("no lines", name)
        for title, section, n, line in self._titled(f, size):
            if line is not None and last[title] == section:
                yield name, title, section, n, line, None

    @staticmethod
    def _titled(f, size: int) -> Iterator[tuple[str | None, int, int, str | None]]:
        """(title, number of the section, number of the line, line); the line is None for a title."""
        title, section = None, 0
        for n, (_, said) in enumerate(lines(f, 0, size)):
            if not (line := stripped(_text(said))):
                continue
            if is_title(line):
                title, section = title_of(line), section + 1
                yield title, section, n, None
            else:
                yield title, section, n, line


class _Batch(DataSourceReader):
    def __init__(self, reader: _Reader):
        self.reader = reader

    def partitions(self) -> list[Pack]:
        # a task more costs little, and without any Spark would read one that is undefined
        return self.reader.packs(listed(self.reader.options)) or [Pack([])]

    def read(self, partition: Pack) -> Iterator[pa.RecordBatch]:
        return self.reader.read(partition)


class _Stream(DataSourceStreamReader):
    def __init__(self, reader: _Reader):
        self.reader = reader

    def initialOffset(self) -> dict:
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:
        until = time.time_ns() - int(float(self.reader.options.get("settle", 1)) * 1e9)
        there = [(changed, path) for changed, path, _ in listed(self.reader.options) if changed <= until]
        return dict(zip(("time", "path"), there[-1])) if there else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Pack]:
        after, until = ((o["time"], o["path"]) for o in (start, end))
        return self.reader.packs([f for f in listed(self.reader.options) if after < f[:2] <= until])

    def read(self, partition: Pack) -> Iterator[pa.RecordBatch]:
        return self.reader.read(partition)


class PlateExport(DataSource):
    """(source_file, labels, line, error): a row for each line of a well."""

    @classmethod
    def name(cls) -> str:
        return "plate_export"

    def schema(self) -> str:
        return "source_file string, labels string, line string, error string"

    def reader(self, schema) -> DataSourceReader:
        return _Batch(_Plates(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(_Plates(self.options))


class Protocol(DataSource):
    """(source_file, title, section, line_no, line, error): the lines under the last section of each title."""

    @classmethod
    def name(cls) -> str:
        return "protocol"

    def schema(self) -> str:
        return "source_file string, title string, section long, line_no int, line string, error string"

    def reader(self, schema) -> DataSourceReader:
        return _Batch(_Protocols(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(_Protocols(self.options))


def register_formats(spark: SparkSession) -> None:
    """Make both formats known to a session."""
    for source in (PlateExport, Protocol):
        spark.dataSource.register(source)
