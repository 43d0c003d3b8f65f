"""Reading gzip text files in parallel, member by member.

A gzip file may be a row of members, each compressed on its own, as block compressors
and appending writers make them. The data source here cuts files into ranges of
compressed bytes, one per task. A task starts at the first member that begins in
its range and ends with the first that begins behind it; a line that crosses a border
belongs to the range it starts in. So nothing is read ahead of the job, and a file
of one member, which cannot be cut, is read by the task of its first range
(``gzip_ranges`` tells).

Where a member begins is recognised by its header and by inflating its first bytes.
A task whose last member does not end where the next range begins raises an error,
so that a mistaken beginning never loses or repeats a line.
"""

from __future__ import annotations

import sys
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

# the tasks and the planning process get this module by value
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SPLIT_BYTES = 64 << 20
READ_BYTES = 1 << 20
#: Inflated bytes that a member's beginning has to yield without an error.
PROBE_BYTES = 1 << 16
LINES_PER_BATCH = 10_000
START = b"\x1f\x8b\x08"


def _uri(path: str) -> str:
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return f"file://{path}" if path.startswith("/") else path


def gzip_files(path: str) -> list[tuple[str, int]]:
    """(URI, bytes) of a file, or of the files of a folder but for hidden ones."""
    fs, inner = pafs.FileSystem.from_uri(_uri(path))
    info = fs.get_file_info(inner)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == pafs.FileType.File:
        return [(_uri(path), info.size)]
    found = fs.get_file_info(pafs.FileSelector(inner))
    return [(f"{_uri(path).rstrip('/')}/{f.base_name}", f.size)
            for f in sorted(found, key=lambda f: f.path)
            if f.type == pafs.FileType.File and f.base_name[0] not in "._"]


def _begins(file, at: int) -> bool:
    """Whether the bytes from ``at`` on inflate as a member."""
    file.seek(at)
    inflate, got = zlib.decompressobj(31), 0
    try:
        while got < PROBE_BYTES and not inflate.eof:
            piece = file.read(READ_BYTES >> 4)
            if not piece:
                return False
            got += len(inflate.decompress(piece, PROBE_BYTES))
            while inflate.unconsumed_tail and got < PROBE_BYTES:
                got += len(inflate.decompress(inflate.unconsumed_tail, PROBE_BYTES))
    except zlib.error:
        return False
    return True


def first_member(file, low: int, high: int) -> int | None:
    """The first place in [low, high) where a member begins."""
    at, tail = low, b""
    while at < high:
        file.seek(at)
        block = tail + file.read(min(READ_BYTES, high - at + len(START) - 1))
        base, found = at - len(tail), block.find(START)
        if len(block) == len(tail):
            return None
        at = base + len(block)
        while found >= 0 and base + found < high:
            if _begins(file, base + found):
                return base + found
            found = block.find(START, found + 1)
        tail = block[1 - len(START):]
    return None


def member_bytes(file, at: int) -> Iterator[tuple[bytes, int | None]]:
    """(inflated bytes, None) of the member at ``at``, then (b"", the place behind it)."""
    file.seek(at)
    inflate, read = zlib.decompressobj(31), at
    while not inflate.eof:
        piece = inflate.unconsumed_tail
        if not piece:
            piece = file.read(READ_BYTES)
            read += len(piece)
            if not piece:
                raise ValueError(f"the gzip member at byte {at} is cut off")
        out = inflate.decompress(piece, 4 * READ_BYTES)
        if out:
            yield out, None
    yield b"", read - len(inflate.unused_data)


def range_lines(uri: str, low: int, high: int, size: int) -> Iterator[bytes]:
    """Lines that start in the members beginning in [low, high)."""
    fs, path = pafs.FileSystem.from_uri(uri)
    with fs.open_input_file(path) as file:
        at = first_member(file, low, high)
        if low == 0 and at != 0 and size:
            raise ValueError(f"{uri} does not begin as a gzip file")
        if at is None:
            return
        held: list[bytes] = []  # of the line that is not at its end yet
        skip = at > 0           # the rest of a line of the range before
        checked = False
        while at < size:
            if at >= high and not checked:
                checked = True
                if first_member(file, high, at + 1) != at:
                    raise ValueError(f"{uri}: no gzip member ends where one begins at byte {at}")
            start, at = at, None
            for data, end in member_bytes(file, start):
                at = end
                lines = data.split(b"\n")
                if len(lines) > 1:
                    if skip:
                        skip = False
                    else:
                        yield b"".join([*held, lines[0]])
                    if start >= high:  # one line into the next range
                        return
                    yield from lines[1:-1]
                    held = []
                if not skip:
                    held.append(lines[-1])
        if b"".join(held):
            yield b"".join(held)


class _Range(InputPartition):
    def __init__(self, uri: str, low: int, high: int, size: int):
        self.uri, self.low, self.high, self.size = uri, low, high, size


class _Lines(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = options["paths"].split("\n")
        self.step = int(options["splitbytes"])
        self.skip = options["header"]

    def partitions(self) -> list[_Range]:
        return [_Range(uri, low, min(size, low + self.step), size)
                for path in self.paths for uri, size in gzip_files(path)
                for low in range(0, size, self.step)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        rows = range_lines(partition.uri, partition.low, partition.high, partition.size)
        if partition.low == 0 and self.skip:
            head = next(rows, b"").rstrip(b"\r").decode()
            if head and head != self.skip:
                raise ValueError(f"{partition.uri}: the header is {head!r}, not {self.skip!r}")
        batch: list[str] = []
        for line in rows:
            line = line.rstrip(b"\r")
            if line:
                batch.append(line.decode())
            if len(batch) == LINES_PER_BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(batch, pa.string())], names=["line"])
                batch = []
        if batch:
            yield pa.RecordBatch.from_arrays([pa.array(batch, pa.string())], names=["line"])


class GzipLines(DataSource):
    """Spark data source ``gzip_lines``: non-blank lines, one partition per byte range."""

    @classmethod
    def name(cls) -> str:
        return "gzip_lines"

    def schema(self) -> str:
        return "line string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Lines({k.lower(): v for k, v in self.options.items()})


def read_gzip_lines(spark: SparkSession, path: str | list[str], split_bytes: int = SPLIT_BYTES,
                    header: str = "") -> DataFrame:
    """``line``: the non-blank lines of gzip files; ``header`` has to be each file's first line."""
    if split_bytes <= 0:
        raise ValueError("'split_bytes' must be positive")
    paths = [path] if isinstance(path, str) else list(path)
    spark.dataSource.register(GzipLines)
    return (spark.read.format("gzip_lines").option("paths", "\n".join(paths))
            .option("splitbytes", str(split_bytes)).option("header", header).load())


def read_gzip_csv(spark: SparkSession, path: str | list[str], schema: StructType,
                  split_bytes: int = SPLIT_BYTES, header: bool = True) -> DataFrame:
    """Gzip CSV with one fixed schema, decoded by ranges; a malformed row fails the job.

    A record is a line: quoted line breaks are not supported. The header, where there
    is one, has to name the schema's columns in order.
    """
    lines = read_gzip_lines(spark, path, split_bytes,
                            ",".join(schema.fieldNames()) if header else "")
    row = F.from_csv("line", schema.simpleString()[7:-1].replace(":", " "), {"mode": "FAILFAST"})
    return lines.select(row.alias("r")).select("r.*")


def gzip_ranges(spark: SparkSession, path: str | list[str],
                split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """``file, low, high, first_member`` per range; null where no member begins in it.

    A file whose ranges behind the first are all null is read by one task.
    """
    paths = [path] if isinstance(path, str) else list(path)
    ranges = [(uri, low, min(size, low + split_bytes)) for p in paths
              for uri, size in gzip_files(p) for low in range(0, size, split_bytes)]

    def find(batches):
        for b in batches:
            found = []
            for uri, low, high in zip(*(c.to_pylist() for c in b.columns)):
                fs, inner = pafs.FileSystem.from_uri(uri)
                with fs.open_input_file(inner) as file:
                    found.append(first_member(file, low, high))
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(found, pa.int64())],
                names=["file", "low", "high", "first_member"])

    listed = spark.createDataFrame(ranges, "file string, low long, high long")
    return listed.repartition(max(1, len(ranges)), "file", "low").mapInArrow(
        find, "file string, low long, high long, first_member long")


def write_gzip_csv(df: DataFrame, folder: str, member_rows: int = 100_000) -> str:
    """Write CSV files of many gzip members, a file per partition, each with a header.

    Members hold about as many rows and end anywhere in a line, as block compressors cut
    them. Returns ``folder``. A file appears under its name once it is whole.
    """
    if member_rows <= 0:
        raise ValueError("'member_rows' must be positive")
    head, uri = ",".join(df.columns), _uri(folder)

    def write(batches):
        fs, base = pafs.FileSystem.from_uri(uri)
        fs.create_dir(base, recursive=True)
        name = uuid.uuid4().hex
        rows, rest = 0, (head + "\n").encode()
        with fs.open_output_stream(f"{base}/.{name}", compression=None) as out:
            def member(data: bytes) -> None:
                packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                out.write(packer.compress(data) + packer.flush())

            for b in batches:
                for i in range(0, b.num_rows, member_rows):
                    lines = b.column(0).slice(i, member_rows).to_pylist()
                    data = rest + ("\n".join(lines) + "\n").encode()
                    cut = max(1, len(data) - 7)
                    member(data[:cut])
                    rest, rows = data[cut:], rows + len(lines)
            member(rest)
        fs.move(f"{base}/.{name}", f"{base}/{name}.csv.gz")
        yield pa.RecordBatch.from_pydict({"rows": [rows]})

    df.select(F.to_csv(F.struct(*df.columns)).alias("line")).mapInArrow(
        write, "rows long").agg(F.sum("rows")).collect()
    return folder
