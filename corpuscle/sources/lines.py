"""Lines of text files with their place: a partitioned reader that numbers lines over splits.

Files are cut into byte ranges of one size, whatever the cluster's settings, so that a range means the same in every pass. A
first pass counts the line ends in each range, a prefix sum gives the number of each range's first line, and
the second pass reads the lines. A line belongs to the range in which it begins. No text is shuffled or sorted.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from fnmatch import fnmatch

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a range, and of a read.
RANGE, READ = 64 << 20, 4 << 20


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The Arrow file system of a path or URI, and the path in it."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def files(path: str, pattern: str = "*") -> list[tuple[str, int]]:
    """(path below `path`, bytes) of its files in order of name; names that begin with '.' or '_' are not data."""
    fs, root = filesystem(path)
    if (info := fs.get_file_info(root)).type == pafs.FileType.File:
        return [("", info.size)]
    found = []
    for f in fs.get_file_info(pafs.FileSelector(root, recursive=True)):
        below = f.path[len(root.rstrip("/")) + 1 :]
        if f.type == pafs.FileType.File and fnmatch(f.base_name, pattern) and not any(p[:1] in "._" for p in below.split("/")):
            found.append((below, f.size))
    return sorted(found)


@dataclass
class Range(InputPartition):
    file: str
    start: int
    end: int
    first: int = 0


class LineReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.size = options["path"], int(options.get("range", RANGE))
        self.pattern, self.counting = options.get("pattern", "*"), options.get("counting") == "true"
        self.firsts = {(f, s): n for f, s, n in json.loads(options.get("firsts", "[]"))}

    def partitions(self) -> list[Range]:
        out = []
        for name, size in files(self.path, self.pattern):
            for start in range(0, size, self.size):
                if not self.counting and (name, start) not in self.firsts:
                    raise ValueError(f"{name!r} has changed since its lines were counted")
                out.append(Range(name, start, min(start + self.size, size), self.firsts.get((name, start), 0)))
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(self.path)
        with fs.open_input_file(f"{root.rstrip('/')}/{partition.file}" if partition.file else root) as f:
            yield from self._count(f, partition) if self.counting else self._lines(f, partition)

    def _count(self, f, p: Range) -> Iterator[pa.RecordBatch]:
        """How many lines begin in the range: at the file's start, and after each line end but the range's last byte."""
        at = max(p.start - 1, 0)
        f.seek(at)
        n, left = int(p.start == 0), p.end - 1 - at
        while left and (part := f.read(min(READ, left))):
            n, left = n + part.count(b"\n"), left - len(part)
        yield pa.RecordBatch.from_arrays([pa.array([p.file]), pa.array([p.start], pa.int64()), pa.array([n], pa.int64())], names=["file", "start", "lines"])

    def _lines(self, f, p: Range) -> Iterator[pa.RecordBatch]:
        """The lines that begin in the range, whole, also past its end."""
        begin, ord_ = max(p.start - 1, 0), p.first  # where the line in `held` begins
        f.seek(begin)
        skipping, held = p.start > 0, []  # what comes before the first line end belongs to the range before
        while begin < p.end and (part := f.read(READ)):
            if skipping:
                cut = part.find(b"\n") + 1
                begin += cut or len(part)
                part, skipping = part[cut:] if cut else b"", not cut
            first, *more = part.split(b"\n")
            held.append(first)
            if not more:
                continue
            kept = []
            for line in [b"".join(held), *more[:-1]]:
                if begin < p.end:
                    kept.append(line)
                    begin += len(line) + 1
            held = [more[-1]]
            if kept:
                yield self._batch(p.file, ord_, kept)
                ord_ += len(kept)
        if not skipping and begin < p.end and (rest := b"".join(held)):
            yield self._batch(p.file, ord_, [rest])

    @staticmethod
    def _batch(file: str, ord_: int, lines: list[bytes]) -> pa.RecordBatch:
        text = [x[:-1] if x.endswith(b"\r") else x for x in lines]
        n = len(text)
        return pa.RecordBatch.from_arrays([pa.array([file] * n), pa.array(range(ord_, ord_ + n), pa.int64()), pa.array([x.decode("utf-8", "replace") for x in text])], names=["file", "ord", "line"])


class Lines(DataSource):
    """``spark.read.format("numbered_lines")``; :func:`ordered_lines` makes both passes."""

    @classmethod
    def name(cls) -> str:
        return "numbered_lines"

    def schema(self) -> str:
        return "file string, start long, lines long" if self.options.get("counting") == "true" else "file string, ord long, line string"

    def reader(self, schema) -> DataSourceReader:
        return LineReader(self.options)


def ordered_lines(spark: SparkSession, path: str, pattern: str = "*", size: int = RANGE) -> DataFrame:
    """(file, ord, line): every line of the files below `path` with its number from 0; file: the path below `path`.

    Lines end with LF or CRLF, the last one needs no end; an empty line is a line, an empty file has none. Bytes
    that are not UTF-8 become U+FFFD. The path is one that Arrow's file systems open (local, HDFS, S3, GCS). A row a range, of
    `size` bytes, reaches the driver.
    """
    spark.dataSource.register(Lines)
    read = spark.read.format("numbered_lines").option("path", path).option("pattern", pattern).option("range", str(size))
    counts = map(tuple, read.option("counting", "true").load().collect())
    return read.option("counting", "false").option("firsts", json.dumps(firsts(counts))).load()


def firsts(counts: Iterable[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """(file, start, number of the first line that begins in the range) from (file, start, lines that begin in it)."""
    out, now, n = [], None, 0
    for file, start, lines in sorted(counts):
        n = n if file == now else 0
        out.append((file, start, n))
        now, n = file, n + lines
    return out


def json_records(lines: DataFrame, schema: str) -> DataFrame:
    """(file, ord, the schema's columns, _corrupt): a JSON object a line, in its place; lines that don't parse keep their text in _corrupt."""
    parsed = lines.select("file", "ord", "line", F.from_json("line", f"{schema}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    return parsed.filter(F.trim("line") != "").select("file", "ord", "r.*")
