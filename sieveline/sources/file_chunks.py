"""Files of any size: a data source whose partitions are byte ranges, and one that reads each file through once.

No cell holds more than a chunk and its surroundings, so a file may be larger than a cell (2 GB) or a task's memory. Paths are
those that ``pyarrow.fs`` knows (local, ``hdfs``, ``s3``, ``gs``). The driver lists the files: a path and a length each.
"""

from __future__ import annotations

import codecs
import fnmatch
import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from sieveline.functions.catalog import CHUNK_CHARS

#: Bytes of a chunk, of the surroundings it carries on either side, and of what a task reads.
CHUNK, OVERLAP, SPLIT = 8 << 20, 1 << 16, 128 << 20
#: First bytes of a file that go with its digest: enough for its signature and a preview of any characters.
HEAD = 4 * CHUNK_CHARS
#: What a zip of an Office document has somewhere.
OFFICE_PARTS = (b"[Content_Types].xml", b"word/")
BLANKS = (b" ", b"\n", b"\t")
CHUNK_ROW = pa.schema([("path", pa.string()), ("length", pa.int64()), ("start", pa.int64()), ("stop", pa.int64()), ("lead", pa.int32()), ("content", pa.binary())])


@dataclass(frozen=True)
class Range:
    file: str
    length: int
    start: int
    stop: int


@dataclass
class Ranges(InputPartition):
    ranges: tuple[Range, ...]


def located(uri: str) -> tuple[fs.FileSystem, str, str]:
    """The file system of a path or URI, the path on it, and what precedes that in a URI."""
    system, base = fs.FileSystem.from_uri(uri if ":/" in uri else f"file://{uri}")
    return system, base, "file:" if isinstance(system, fs.LocalFileSystem) else uri[:uri.index(base)]


def list_files(uri: str, glob: str | None = None) -> list[tuple[str, int]]:
    """Paths and lengths of the files below; hidden files (``.``, ``_``) are left out."""
    system, base, _ = located(uri)
    info = system.get_file_info(base)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(base, recursive=True))
    inside = len(base.rstrip("/")) + 1
    return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and (glob is None or fnmatch.fnmatch(f.base_name, glob))
                  and not any(part[0] in "._" for part in f.path[inside:].split("/") if part))


def dealt(files: Sequence[tuple[str, int]], split: int, whole: bool) -> list[Ranges]:
    """Files cut into ranges of at most ``split`` bytes (uncut if ``whole``), short ones together in one partition."""
    parts: list[Ranges] = []
    held: list[Range] = []
    size = 0
    for path, length in files:
        step = max(1, length) if whole else split
        for start in range(0, max(1, length), step):
            piece = Range(path, length, start, min(length, start + step))
            if held and size + piece.stop - piece.start > split:
                parts.append(Ranges(tuple(held)))
                held, size = [], 0
            held.append(piece)
            size += piece.stop - piece.start
    return [*parts, Ranges(tuple(held))] if held else parts


def surroundings(data: bytes, lead: int, tail: int) -> tuple[int, int]:
    """Where to cut ``data`` so that it begins and ends at white space in its surroundings, or else between characters.

    ``lead`` bytes precede the chunk and ``tail`` follow it; zero means no cut on that side.
    """
    first, last = 0, len(data)
    # Only the outer half is searched, so that the inner half is always there.
    if lead:
        blanks = [p for p in (data.find(b, 0, lead // 2) for b in BLANKS) if p >= 0]
        first = min(blanks, default=0)
        while not blanks and first < lead // 2 and data[first] & 0xC0 == 0x80:
            first += 1
    if tail:
        blank = max(data.rfind(b, last - tail // 2) for b in BLANKS)
        if blank >= 0:
            return first, blank + 1
        border = last
        while border > last - tail // 2 and data[border - 1] & 0xC0 == 0x80:
            border -= 1
        if border > last - tail // 2 and data[border - 1] >= 0xC0:
            border -= 1
        last = border
    return first, last


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(column, field.type) for column, field in zip(zip(*rows), CHUNK_ROW)], schema=CHUNK_ROW)


class _Reader(DataSourceReader):
    def __init__(self, options: dict, whole: bool) -> None:
        self.uri, self.glob, self.whole = options["path"], options.get("glob"), whole
        self.chunk, self.overlap = int(options.get("chunk", CHUNK)), int(options.get("overlap", OVERLAP))
        self.split = max(self.chunk, int(options.get("split", SPLIT)))
        if self.chunk < 1 or self.overlap < 0:
            raise ValueError("chunk must be positive and overlap not negative")

    def partitions(self) -> list[InputPartition]:
        # Without files there is one empty partition.
        return dealt(list_files(self.uri, self.glob), self.split, self.whole) or [Ranges(())]

    def read(self, partition: Ranges) -> Iterator[tuple | pa.RecordBatch]:
        """Batches of about a chunk; Spark's own batches would go by rows, however large they are."""
        system, _, prefix = located(self.uri)
        rows: list[tuple] = []
        size = 0
        for part in partition.ranges:
            with system.open_input_file(part.file) as source:
                if self.whole:
                    yield self.digest(source, part, prefix + part.file)
                    continue
                for row in self.chunks(source, part, prefix + part.file):
                    rows.append(row)
                    size += len(row[-1])
                    if size >= self.chunk:
                        yield _batch(rows)
                        rows, size = [], 0
        if rows:
            yield _batch(rows)

    def chunks(self, source, part: Range, name: str) -> Iterator[tuple]:
        for start in range(part.start, part.stop, self.chunk):
            stop = min(part.stop, start + self.chunk)
            lead, tail = min(self.overlap, start), min(self.overlap, part.length - stop)
            data = source.read_at(stop - start + lead + tail, start - lead)
            # What begins or ends with the file needs no cut.
            first, last = surroundings(data, lead if lead < start else 0, tail if stop + tail < part.length else 0)
            yield name, part.length, start, stop, lead - first, data[first:last]

    def digest(self, source, part: Range, name: str) -> tuple:
        sha, head, carry = hashlib.sha256(), b"", b""
        decoder = codecs.getincrementaldecoder("utf-8")()
        office, plain = False, True
        while data := source.read(self.chunk):
            sha.update(data)
            head += data[:HEAD - len(head)]
            near = carry + data
            office = office or any(known in near for known in OFFICE_PARTS)
            carry = near[-max(map(len, OFFICE_PARTS)):]
            if plain:
                try:
                    plain = b"\0" not in data and decoder.decode(data) is not None
                except UnicodeDecodeError:
                    plain = False
        if plain:
            try:
                decoder.decode(b"", final=True)
            except UnicodeDecodeError:
                plain = False
        return name, part.length, sha.hexdigest(), head, office, plain


class FileChunks(DataSource):
    """Rows ``path, length, start, stop, lead, content``: bytes ``start`` to ``stop`` of a file, after ``lead`` bytes before them."""

    @classmethod
    def name(cls) -> str:
        return "file_chunks"

    def schema(self) -> str:
        return "path string, length bigint, start bigint, stop bigint, lead int, content binary"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options), whole=False)


class FileDigests(DataSource):
    """Rows ``path, length, hash, head, office, plain``: SHA-256, first bytes and kind of a file. One task reads a file, as a
    digest needs its bytes in order, a chunk at a time."""

    @classmethod
    def name(cls) -> str:
        return "file_digests"

    def schema(self) -> str:
        return "path string, length bigint, hash string, head binary, office boolean, plain boolean"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options), whole=True)


def _scan(spark: SparkSession, source: type[DataSource], path: str, glob: str | None, **options: int) -> DataFrame:
    spark.dataSource.register(source)
    reader = spark.read.format(source.name()).options(**options)
    return (reader if glob is None else reader.option("glob", glob)).load(path)


def scan_chunks(spark: SparkSession, path: str, glob: str | None = None, *, chunk: int = CHUNK, overlap: int = OVERLAP, split: int = SPLIT) -> DataFrame:
    """Contents of files in chunks (see ``FileChunks``). ``content`` goes up to ``overlap`` bytes beyond the chunk on either side,
    but at least half of that, cut at white space if there is any in between. Empty files have no chunk."""
    return _scan(spark, FileChunks, path, glob, chunk=chunk, overlap=overlap, split=split)


def scan_digests(spark: SparkSession, path: str, glob: str | None = None, *, chunk: int = CHUNK, split: int = SPLIT) -> DataFrame:
    """Digest and kind of each file (see ``FileDigests``); an empty file has an empty ``head`` and is plain."""
    return _scan(spark, FileDigests, path, glob, chunk=chunk, split=split)
