"""Token-id files: frequency-ranked ids, byte-aligned variable length, control bytes apart.

Ids are counted over the corpus and replaced by their rank, so that frequent ones
need one byte. A value takes one to four bytes; its length, two bits, goes to a
control stream, four values a byte. Both streams, an index of the documents and
the number of the shard make a file; the ranks are a file beside them, as long
as the vocabulary. Decoding takes four lengths at a time from a table of all
256 control bytes and gathers the data bytes column by column.

Documents are range-partitioned by doc_id and sorted within a shard's partition;
a partition writes files of bounded size, numbered in order.

Nulls: a null text is empty and holds the end id alone; a null doc_id comes
first. Rows that repeat a doc_id follow each other, ordered by their ids. An empty
table gives no shard. Extra columns are left out.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from adspark.llm._common import byte_texts, parts_for, stored
from adspark.llm.files import put_file, read_files
from adspark.llm.tokens import Encoder

MAGIC = b"IDF2"
FILE_IDS = 1_000_000
SHARD_BYTES = 16_000_000
#: Lengths of the four values of every control byte.
LENGTHS = (((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1).astype(np.uint8)
#: The bits that a value of a length has.
MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data streams of unsigned 32-bit values."""
    v = values.astype(np.uint32)
    n = 1 + (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    codes = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    codes[:len(v)] = n - 1
    control = codes.reshape(-1, 4) @ np.array([1, 4, 16, 64], np.uint8)
    raw = v.astype("<u4").view(np.uint8).reshape(-1, 4)
    return control.astype(np.uint8).tobytes(), raw[np.arange(4, dtype=np.uint8) < n[:, None]].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` values of two streams."""
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    start = np.cumsum(lengths, dtype=np.int64) - lengths
    raw = np.frombuffer(data + b"\0\0\0\0", np.uint8)
    words = np.ndarray((len(raw) - 3,), "<u4", raw.data, strides=(1,))  # four bytes from any place
    return words[start] & MASKS[lengths]


def shard_bytes(shard: int, docs: list, ids: list[np.ndarray], rank: np.ndarray) -> bytes:
    """A file: magic, shard, documents, ids, stream sizes; doc ids, a bit where there is one; counts; streams."""
    counts = np.array([len(x) for x in ids], "<u4")
    names = np.array([0 if d is None else d for d in docs], "<i8")
    named = np.packbits([d is not None for d in docs])
    control, data = pack(rank[np.concatenate(ids)])
    head = MAGIC + struct.pack("<QQQQQ", shard, len(docs), int(counts.sum()), len(control),
                               len(data))
    return head + names.tobytes() + named.tobytes() + counts.tobytes() + control + data


def shard_docs(content: bytes, ids_by_rank: np.ndarray):
    """(shard, doc ids, which of them are given, starts in the shard, counts, ids) of a file."""
    if content[:4] != MAGIC:
        raise ValueError("not a token-id file")
    shard, docs, n, c, d = struct.unpack_from("<QQQQQ", content, 4)
    at = 44
    names = np.frombuffer(content, "<i8", docs, at)
    bits = np.frombuffer(content, np.uint8, -(-docs // 8), at + 8 * docs)
    named = np.unpackbits(bits, count=docs).astype(bool)
    at += 8 * docs + len(bits)
    counts = np.frombuffer(content, "<u4", docs, at).astype(np.int64)
    at += 4 * docs
    ranks = unpack(content[at:at + c], content[at + c:at + c + d], n)
    return shard, names, named, np.cumsum(counts) - counts, counts, ids_by_rank[ranks]


def tokenized(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """doc_id, n, ids (little-endian, of the smallest width that fits), written once."""
    def encode(batches):
        encoder = Encoder(path, "word")
        end = np.array([end_id], encoder.type).tobytes()
        for b in batches:
            ids = [x + end for x in encoder.encode(byte_texts(b))]
            width = encoder.type.itemsize
            yield pa.RecordBatch.from_arrays(
                [b.column(b.schema.get_field_index("doc_id")),
                 pa.array([len(x) // width for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                names=["doc_id", "n", "ids"])

    return stored(docs.select("doc_id", "text").mapInArrow(
        encode, "doc_id bigint, n bigint, ids binary"), "token-ids")


def ranking(tokens: DataFrame, size: int, dtype: str) -> np.ndarray:
    """Ids in order of falling frequency; ``size`` (the vocabulary's) bounds what is collected."""
    def count(batches):
        total = np.zeros(size, np.int64)
        for b in batches:
            ids = np.frombuffer(b"".join(b.column(0).to_pylist()), dtype)
            total += np.bincount(ids, minlength=size)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(seen, pa.int64()), pa.array(total[seen])], names=["id", "n"])

    counted = (tokens.select("ids").mapInArrow(count, "id bigint, n bigint")
               .groupBy("id").agg(F.sum("n").alias("n")).toPandas())
    total = np.zeros(size, np.int64)
    total[counted["id"].to_numpy(np.int64)] = counted["n"].to_numpy(np.int64)
    return np.argsort(-total, kind="stable")


def write_id_files(docs: DataFrame, folder: str, path: str, end_id: int) -> DataFrame:
    """Tokenize all documents and write them under ``folder``; the stored list of files."""
    from tokenizers import Tokenizer

    size = max(Tokenizer.from_file(path).get_vocab_size(), end_id + 1)
    dtype = "<u2" if size <= 65_536 else "<u4"
    tokens = tokenized(docs, path, end_id)
    by_rank = ranking(tokens, size, dtype)
    put_file(f"{folder}/ranks.bin", by_rank.astype("<u4").tobytes())
    rank = np.empty(size, np.uint32)
    rank[by_rank] = np.arange(size, dtype=np.uint32)
    total = tokens.agg(F.sum("n")).first()[0] or 0
    parts = parts_for(total * int(dtype[-1]), SHARD_BYTES)

    def write(batches):
        task, count, names, ids, held = TaskContext.get().partitionId(), 0, [], [], 0

        def flush():
            shard = task * 1_000_000 + count
            put_file(f"{folder}/{shard:015d}.idf", shard_bytes(shard, names, ids, rank))
            return pa.RecordBatch.from_pydict(
                {"shard": [shard], "docs": [len(names)], "ids": [held]})

        for b in batches:
            for name, x in zip(b.column(0).to_pylist(), b.column(1)):
                names.append(name)
                ids.append(np.frombuffer(x.as_py(), dtype))
                held += len(ids[-1])
                if held >= FILE_IDS:
                    yield flush()
                    count, names, ids, held = count + 1, [], [], 0
        if names:
            yield flush()

    ordered = (tokens.select("doc_id", "ids").repartitionByRange(parts, F.asc_nulls_first("doc_id"))
               .sortWithinPartitions(F.asc_nulls_first("doc_id"), "ids"))
    return stored(ordered.mapInArrow(write, "shard bigint, docs bigint, ids bigint"), "id-files")


def read_id_files(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, shard, start (in all files), n_tokens, ids (little-endian 32-bit) from the files."""
    ranks = read_files(spark, folder, "ranks.bin").first()["content"]
    by_rank = np.frombuffer(ranks, "<u4")
    files = read_files(spark, folder, "*.idf")

    def heads(batches):
        for b in batches:
            got = [struct.unpack_from("<QQQ", c.as_py(), 4) for c in b.column(0)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([g[0] for g in got], pa.int64()),
                 pa.array([g[2] for g in got], pa.int64())], names=["shard", "n"])

    def decode(batches):
        for b in batches:
            for c in b.column(0):
                shard, names, named, start, n, ids = shard_docs(c.as_py(), by_rank)
                raw = ids.astype("<u4").tobytes()
                for i in range(0, len(names), 2000):
                    at = slice(i, i + 2000)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(names[at], pa.int64(), mask=~named[at]),
                         pa.array(np.full(len(names[at]), shard, np.int64)),
                         pa.array(start[at]), pa.array(n[at]),
                         pa.array([raw[4 * s:4 * (s + k)] for s, k in zip(start[at], n[at])],
                                  pa.binary())],
                        names=["doc_id", "shard", "local", "n_tokens", "ids"])

    # one row per file: the ids before each file, in order of the shards
    before = F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    base = stored(files.select("content").mapInArrow(heads, "shard bigint, n bigint")
                  .select("shard", F.coalesce(before, F.lit(0)).alias("base")), "id-bases")
    docs = files.select("content").mapInArrow(
        decode, "doc_id bigint, shard bigint, local bigint, n_tokens bigint, ids binary")
    return docs.join(base, "shard").select(
        "doc_id", "shard", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids")


def crc_of_ids(batches):
    """Replaces ``ids`` by their checksum."""
    for b in batches:
        crc = pa.array([zlib.crc32(x.as_py()) for x in b.column(b.num_columns - 1)], pa.int64())
        yield pa.RecordBatch.from_arrays(
            [*b.columns[:-1], crc], names=[*b.schema.names[:-1], "ids_crc32"])
