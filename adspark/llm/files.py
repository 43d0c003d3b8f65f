"""Files in the shared folder, written by tasks and read back by Spark."""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession


def put_file(uri: str, data: bytes) -> None:
    """Write a whole file under a name of its own, then rename: a retried task repeats it."""
    fs, path = pafs.FileSystem.from_uri(uri)
    fs.create_dir(posixpath.dirname(path), recursive=True)
    own = f"{posixpath.dirname(path)}/.{posixpath.basename(path)}.{uuid.uuid4().hex}"
    with fs.open_output_stream(own, compression=None) as out:
        out.write(data)
    fs.move(own, path)


def as_uri(path: str) -> str:
    """A local path as a URI; other URIs as they are."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return f"file://{path}" if path.startswith("/") else path


def written_batches(uri: str, rows: int) -> Iterator[pa.RecordBatch]:
    """The rows of a table that Spark has written as Parquet, so many at once, in a task."""
    fs, at = pafs.FileSystem.from_uri(uri)
    for f in sorted(fs.get_file_info(pafs.FileSelector(at)), key=lambda f: f.path):
        if f.base_name.startswith("part-"):
            with fs.open_input_file(f.path) as data:
                yield from pq.ParquetFile(data).iter_batches(rows)


def read_files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """path, content of the files of a folder (one row per file)."""
    return (spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
            .select("path", "content"))
