"""Shared helpers: words, texts of Arrow batches, hashes, storage in the shared folder."""

from __future__ import annotations

import ctypes
import math
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from adspark.sources.scratch import kept, materialize, released

BATCH = ("spark.sql.execution.arrow.maxRecordsPerBatch",
         "spark.sql.execution.arrow.maxBytesPerBatch")
#: A word, in SQL: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Entries of a worker's hash cache; it starts again when full.
CACHE_WORDS = 400_000


def words(text: bytes) -> list[bytes]:
    """Words of UTF-8 bytes with A-Z lower-cased; ``bytes`` methods touch ASCII only."""
    return text.lower().split()


def byte_texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The texts of a batch as UTF-8 bytes; null is the empty text."""
    col = batch.column(batch.schema.get_field_index(column)).cast(pa.binary())
    return [t or b"" for t in col.to_pylist()]


class WordHashes(dict):
    """64-bit hash of each word, remembered up to ``CACHE_WORDS`` words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, ws: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, ws), np.uint64, len(ws))


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit mixing of unsigned integers (xor-shift and multiply)."""
    x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(hashed: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of runs of ``n`` words; fewer words are one run; none, none."""
    if not len(hashed):
        return hashed
    k = min(n, len(hashed))
    m = len(hashed) - k + 1
    acc = mixed(hashed[:m], k)
    for i in range(1, k):
        acc = mixed(acc ^ hashed[i:i + m], i)
    return np.unique(acc)


def parts_for(n_bytes: int, per_part: int, least: int = 1) -> int:
    """Parts of about ``per_part`` bytes."""
    return max(least, math.ceil(n_bytes / per_part))


@contextmanager
def arrow_batches(spark: SparkSession, rows: int, n_bytes: int) -> Iterator[None]:
    """Python tasks of the jobs inside get their rows in batches of so many and of so many bytes."""
    conf = spark.conf
    held = {k: conf.get(k, None) for k in BATCH}
    for k, v in zip(BATCH, (rows, n_bytes)):
        conf.set(k, str(v))
    try:
        yield
    finally:
        for k, v in held.items():
            conf.unset(k) if v is None else conf.set(k, v)


def stored(df: DataFrame, label: str, rows_per_batch: int = 1000,
           bytes_per_batch: int = 32 << 20) -> DataFrame:
    """Write to the shared folder and read back: computed once, lineage cut.

    Python tasks of this job get their rows in batches of so many and of so many bytes.
    """
    with arrow_batches(df.sparkSession, rows_per_batch, bytes_per_batch):
        return materialize(df, f"llm-{label}")


def settled(spark: SparkSession, make: Callable[[], DataFrame], label: str) -> DataFrame:
    """The rows that ``make`` returns, written; every other table it wrote is deleted."""
    with released(spark):
        return kept(stored(make(), label))


def give_back() -> None:
    """Return what freed arrays have left in this worker to the system; workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def unused(name: str, columns: list[str]) -> str:
    """A column name like ``name`` that the columns do not have, in any case of letters."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """Bytes of all texts."""
    row = docs.agg(F.sum(F.octet_length(F.col(text))).alias("n")).first()
    return int(row["n"] or 0)


def known_keys(facts: DataFrame, keys: DataFrame, key: str | list[str], how: str = "left_semi",
               small: int = 2_000_000) -> DataFrame:
    """Semi or anti join of large rows with a table of distinct keys of one to three integers.

    ``keys`` is counted (it should be a stored table): up to ``small`` keys, some
    tens of megabytes, are broadcast; more are joined by a shuffle.
    """
    side = F.broadcast(keys) if keys.count() <= small else keys.hint("shuffle_merge")
    return facts.join(side, key, how)


def spread_lookup(facts: DataFrame, dim: DataFrame, key: str, weight: str, total: int,
                  parts: int, spread: Column) -> DataFrame:
    """Left join with a dimension of one row per ``key`` whose heavy keys are broadcast.

    ``weight`` counts the facts of a key. Keys with over ``total / parts`` of them
    are fewer than ``parts``; they are broadcast, and their facts get a join
    key of their own in the shuffled join that serves the rest.
    """
    limit = max(1, total // parts)
    values = [c for c in dim.columns if c not in (key, weight)]
    hot = dim.filter(F.col(weight) > limit).select(
        F.col(key).alias("_hot"), *[F.col(c).alias(f"_hot_{c}") for c in values])
    cold = dim.filter(F.col(weight) <= limit).select(
        F.col(key).alias("_cold"), *values)
    out = facts.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left")
    out = out.withColumn("_at", F.when(F.col("_hot").isNull(), F.col(key)))
    out = out.withColumn("_lone", F.when(F.col("_at").isNull(), spread).otherwise(F.lit(0)))
    cold = cold.withColumn("_zero", F.lit(0).cast(dict(out.dtypes)["_lone"]))
    out = out.join(cold, (F.col("_at") == F.col("_cold")) & (F.col("_lone") == F.col("_zero")),
                   "left")
    for c in values:
        out = out.withColumn(c, F.coalesce(F.col(f"_hot_{c}"), F.col(c)))
    return out.drop("_hot", "_at", "_lone", "_cold", "_zero", *[f"_hot_{c}" for c in values])
