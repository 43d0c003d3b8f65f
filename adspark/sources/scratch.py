"""Durable intermediate tables.

A fitted state or an encoded fold is written once and read many times. It goes
to the shared folder the session names in ``spark.checkpoint.dir``, so that a
lost executor costs a re-read and not a recomputation of the lineage.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


_scopes = threading.local()
#: Names under which bucketed tables are known to the catalog, by path.
_named: dict[str, str] = {}


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Delete on exit what this thread materialized inside, but for tables that are ``kept``."""
    stack = _scopes.__dict__.setdefault("stack", [])
    stack.append([])
    try:
        yield
    finally:
        for path in stack.pop():
            delete_path(spark, path)


def kept(table: DataFrame) -> DataFrame:
    """Take a materialized table out of the scope of ``released`` around it, into the one outside."""
    stack = _scopes.__dict__.get("stack") or []
    path = table.__dict__.get("_scratch_path")
    if stack and path in stack[-1]:
        stack[-1].remove(path)
        if len(stack) > 1:
            stack[-2].append(path)
    return table


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path (or glob) exists on its file system (needs a classic session, for its JVM)."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(str(path))
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.globStatus(p)
    return found is not None and len(found) > 0


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a path and what is below it, and the catalog's entry of a bucketed table there."""
    name = _named.pop(str(path), None)
    if name is not None:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    p = spark._jvm.org.apache.hadoop.fs.Path(str(path))
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    That is ``spark.checkpoint.dir``. Where it is unset, a folder beside the tables
    of the warehouse, which every executor can reach as well.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    named = named or spark.sparkContext.getCheckpointDir()
    named = named or f"{spark.conf.get('spark.sql.warehouse.dir')}/_scratch"
    return str(named).rstrip("/")


def new_scratch_path(spark: SparkSession, label: str) -> str:
    """A path under the shared folder that nothing else uses."""
    return f"{scratch_root(spark)}/adspark/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str, partition_by: tuple[str, ...] = (),
                sort_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` to the shared folder and return the table read back.

    ``partition_by`` suits columns with a handful of values; ``sort_by`` orders
    rows inside each task, so that readers of one value skip row groups without
    a file per value and task.
    """
    spark = df.sparkSession
    path = new_scratch_path(spark, label)
    writer = (df.sortWithinPartitions(*sort_by) if sort_by else df).write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.__dict__["_scratch_path"] = path
    if _scopes.__dict__.get("stack"):
        _scopes.stack[-1].append(path)
    return table


def materialize_bucketed(df: DataFrame, label: str, columns: list[str],
                         buckets: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder in buckets of ``columns``, sorted by them, and read it.

    Joins and groupings on exactly these columns read the table without a shuffle of
    it; one bucket is one file, and there are as many as shuffle partitions
    unless ``buckets`` says otherwise. The table has an entry in the session's catalog.
    """
    spark = df.sparkSession
    path = new_scratch_path(spark, label)
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"adspark_{path.rsplit('-', 1)[-1]}"
    (df.repartition(n, *columns).write.format("parquet").bucketBy(n, *columns)
     .sortBy(*columns).option("path", path).saveAsTable(name))
    table = spark.table(name)
    _named[path] = name
    table.__dict__["_scratch_path"] = path
    if _scopes.__dict__.get("stack"):
        _scopes.stack[-1].append(path)
    return table


def release(table: DataFrame) -> None:
    """Delete a table that ``materialize`` returned, once nothing reads it any more."""
    path = table.__dict__.pop("_scratch_path", None)
    if path is not None:
        delete_path(table.sparkSession, path)
