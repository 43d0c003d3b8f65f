"""WARC archives with a Zstandard dictionary: writer and reader.

A task collects records up to a bounded size, builds a dictionary from records
spread over them, and writes one file: a leading skippable frame (magic
0x184D2A5D) with the dictionary, then one frame per record. Every file can be
read alone. Records with equal payloads of ``least_bytes`` or more become one
response, that of the smallest page_id, and revisits of it, which carry the
payload's length and digest but not the payload.

Equal payloads are found by digest: counts and smallest ids are aggregated
before the shuffle, and heavy digests are looked up by broadcast, so a payload
with a third of all pages makes no large task.

Nulls: a null html is the empty payload, a null url gives no target URI, a null
page_id is kept as null and is never the response of a group that has an id.
Rows equal in id and payload are all responses. An empty table gives no file.
Extra columns are left out.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from adspark.llm._common import spread_lookup, stored
from adspark.llm.files import put_file, read_files

SKIPPABLE = 0x184D2A5D
DICTIONARY_BYTES = 65_536
FILE_BYTES = 16_000_000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ_SCHEMA = ("page_id bigint, url string, record_type string, refers_to bigint, "
               "payload_bytes bigint, payload_digest string, payload binary")


def with_revisits(pages: DataFrame, least_bytes: int = 100) -> DataFrame:
    """page_id, url, html (bytes; null for revisits), n_bytes, digest, refers_to."""
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", html.alias("html"))
    rows = rows.withColumns({"n_bytes": F.octet_length("html").cast("bigint"),
                             "digest": F.sha2("html", 256)})
    copies = stored(
        rows.filter(F.col("n_bytes") >= least_bytes).groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .filter("n > 1 and first is not null"), "warc-copies")
    spark = pages.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = copies.agg(F.sum("n")).first()[0] or 0
    rows = spread_lookup(rows, copies, "digest", "n", int(total), parts,
                         F.xxhash64("page_id", "url"))
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return rows.withColumn("refers_to", refers).drop("first").withColumn(
        "html", F.when(F.col("refers_to").isNull(), F.col("html")))


def _urn(kind: str, page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{kind}:{page_id}')}>"


def warc_record(page_id, url, payload, n_bytes, digest, refers_to) -> bytes:
    """One WARC/1.1 record with an HTTP response block."""
    revisit = refers_to is not None
    head = [("WARC-Type", "revisit" if revisit else "response"),
            ("WARC-Record-ID", _urn("page", page_id)), ("WARC-Date", DATE)]
    if url is not None:
        head.append(("WARC-Target-URI", " ".join(url.split())))
    if page_id is not None:
        head.append(("X-Page-Id", page_id))
    head.append(("WARC-Payload-Digest", f"sha256:{digest}"))
    if revisit:
        head += [("WARC-Refers-To", _urn("page", refers_to)), ("X-Refers-To-Page", refers_to),
                 ("WARC-Profile", PROFILE)]
    block = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
             f"Content-Length: {n_bytes}\r\n\r\n").encode() + (payload or b"")
    head += [("Content-Type", "application/http; msgtype=response"),
             ("Content-Length", len(block))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in head)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def build_dictionary(records: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """Train on records spread over the file, about 50 times the dictionary's size.

    Too few records to train on serve as a dictionary as they are.
    """
    step = max(1, sum(map(len, records)) // (50 * size))
    sample = records[::step]
    try:
        return zstandard.train_dictionary(size, sample, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(sample)[-size:]


def archive(records: list[bytes], level: int = 6) -> bytes:
    """A file: dictionary frame, then a frame for each record."""
    raw = build_dictionary(records)
    coder = zstandard.ZstdCompressor(
        level=level, dict_data=zstandard.ZstdCompressionDict(raw), write_content_size=True)
    head = struct.pack("<II", SKIPPABLE, len(raw)) + raw
    return head + b"".join(map(coder.compress, records))


def records_of(data: bytes):
    """(headers, block) of every record of a file."""
    magic, n = struct.unpack_from("<II", data)
    if magic != SKIPPABLE:
        raise ValueError("no dictionary frame")
    coder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8:8 + n]))
    stream = io.BufferedReader(
        coder.stream_reader(memoryview(data)[8 + n:], read_across_frames=True), 1 << 20)
    while line := stream.readline():
        if line != b"WARC/1.1\r\n":
            raise ValueError(f"a record starts with {line[:40]!r}")
        head = {}
        while (line := stream.readline()) != b"\r\n":
            k, _, v = line.decode().partition(":")
            head[k] = v.strip()
        block = stream.read(int(head["Content-Length"]))
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError("a record has no end")
        yield head, block


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 100,
                   file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write all pages as archives under ``folder``; returns the stored list of files.

    Tasks write files of their own names, which a retry replaces by the same.
    """
    def write(batches):
        task, count, held, size = TaskContext.get().partitionId(), 0, [], 0

        def flush():
            name = f"{task:06d}-{count:05d}.warc.zst"
            data = archive(held)
            put_file(f"{folder}/{name}", data)
            return pa.RecordBatch.from_pydict(
                {"file": [name], "records": [len(held)], "bytes": [len(data)]})

        for b in batches:
            cols = [b.column(b.schema.get_field_index(c)) for c in (
                "page_id", "url", "html", "n_bytes", "digest", "refers_to")]
            for i in range(b.num_rows):
                r = warc_record(*[c[i].as_py() for c in cols])
                held.append(r)
                size += len(r)
                if size >= file_bytes:
                    yield flush()
                    count, held, size = count + 1, [], 0
        if held:
            yield flush()

    rows = with_revisits(pages, least_bytes)
    return stored(rows.mapInArrow(write, "file string, records bigint, bytes bigint"),
                  "warc-files")


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """The records of all archives under a folder (``READ_SCHEMA``).

    A response's length and digest are taken from its payload and compared with
    its headers; a revisit's are those of its headers.
    """
    def parse(batches):
        names = [x.strip().split()[0] for x in READ_SCHEMA.split(",")]
        for b in batches:
            for content in b.column(b.schema.get_field_index("content")):
                rows, size = [], 0
                for head, block in records_of(content.as_py()):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    n = int(http.rpartition(b"Content-Length: ")[2])
                    digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
                    page, refers = head.get("X-Page-Id"), head.get("X-Refers-To-Page")
                    if head["WARC-Type"] == "response":
                        if len(payload) != n or hashlib.sha256(payload).hexdigest() != digest:
                            raise ValueError(f"record of page {page} is damaged")
                    else:
                        payload = None
                    rows.append((page and int(page), head.get("WARC-Target-URI"),
                                 head["WARC-Type"], refers and int(refers), n, digest, payload))
                    size += len(block)
                    if size > 4_000_000:
                        yield batch_of(rows, names)
                        rows, size = [], 0
                if rows:
                    yield batch_of(rows, names)

    def batch_of(rows, names):
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(),
                 pa.binary()]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return read_files(spark, folder, "*.warc.zst").mapInArrow(parse, READ_SCHEMA)
