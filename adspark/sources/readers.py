"""Reading raw impressions, processed tables and result files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import (
    ByteType, IntegerType, ShortType, StringType, StructField, StructType,
)

from adspark.sources.gzipped import read_gzip_csv
from adspark.sources.scratch import path_exists

# fixed values: column order and types of the raw file; the identifier stays text
# because the raw identifiers do not fit 32 (nor signed 64) bits
_RAW_COLUMNS = (
    ("id", StringType()), ("click", ByteType()), ("hour", IntegerType()),
    ("C1", ShortType()), ("banner_pos", ByteType()),
    ("site_id", StringType()), ("site_domain", StringType()),
    ("site_category", StringType()), ("app_id", StringType()),
    ("app_domain", StringType()), ("app_category", StringType()),
    ("device_id", StringType()), ("device_ip", StringType()),
    ("device_model", StringType()), ("device_type", ByteType()),
    ("device_conn_type", ByteType()), ("C14", IntegerType()),
    ("C15", ShortType()), ("C16", ShortType()), ("C17", IntegerType()),
    ("C18", IntegerType()), ("C19", IntegerType()), ("C20", IntegerType()),
    ("C21", IntegerType()),
)

IMPRESSIONS_SCHEMA = StructType([StructField(n, t) for n, t in _RAW_COLUMNS])


def read_impressions_csv(
    spark: SparkSession, path: str | list[str], schema: StructType = IMPRESSIONS_SCHEMA,
) -> DataFrame:
    """Plain or gzip CSV with a header, one fixed schema for all files.

    A malformed row or a header that differs from the schema fails the job, so
    no value is turned into null silently.
    """
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("enforceSchema", False)
        .option("mode", "FAILFAST")
        .csv(path)
    )


def csv_to_parquet(
    spark: SparkSession,
    source: str | list[str],
    destination: str,
    schema: StructType = IMPRESSIONS_SCHEMA,
    partitions: int | None = None,
    if_exists: str = "ignore",
    gzip_split_bytes: int | None = None,
) -> DataFrame:
    """Convert CSV to Snappy Parquet and return the Parquet table.

    One gzip file is one input split, whatever its size, so the rows are spread
    before the write: over ``partitions`` tasks, or over as many as Spark's
    advisory partition size asks for. With ``gzip_split_bytes``, gzip files are decoded by
    ranges of so many compressed bytes, as far as they consist of several members
    (``read_gzip_csv``; ``gzip_ranges`` tells which do). ``if_exists="ignore"`` keeps a
    finished output, one with Spark's success mark, as it is and replaces any other.
    """
    if if_exists not in ("ignore", "error", "overwrite"):
        raise ValueError("'if_exists' must be 'ignore', 'error' or 'overwrite'")
    if partitions is not None and partitions <= 0:
        raise ValueError("'partitions' must be positive")
    for one in [source] if isinstance(source, str) else source:
        if not path_exists(spark, one):
            raise FileNotFoundError(one)
    if if_exists == "ignore" and not path_exists(spark, f"{destination}/_SUCCESS"):
        if_exists = "overwrite"
    if gzip_split_bytes is None:
        rows = read_impressions_csv(spark, source, schema)
    else:
        rows = read_gzip_csv(spark, source, schema, gzip_split_bytes)
    (
        (rows.repartition(partitions) if partitions else rows.hint("rebalance"))
        .write.mode(if_exists)
        .option("compression", "snappy")
        .parquet(destination)
    )
    return spark.read.parquet(destination)


def register_parquet(spark: SparkSession, path: str, view: str = "raw") -> DataFrame:
    """Register a Parquet path as a temporary view; fail when it is absent."""
    if not path_exists(spark, path):
        raise FileNotFoundError(path)
    df = spark.read.parquet(path)
    df.createOrReplaceTempView(view)
    return df


def read_split(spark: SparkSession, path: str, label: str,
               split_column: str = "split") -> DataFrame:
    """One subset of a table written by ``write_subsets`` (partition pruned)."""
    return spark.read.parquet(path).where(F.col(split_column) == label).drop(split_column)


def read_grid_json(spark: SparkSession, path: str) -> DataFrame:
    """Results of a nested grid-search JSON file, one row per combination.

    The parameter keys vary from grid to grid, so they are read as a map of text
    values; list values lose their line breaks.
    """
    if not path_exists(spark, path):
        raise FileNotFoundError(path)
    schema = (
        "results array<struct<signature:string,params:map<string,string>,"
        "fold_scores:array<double>,fold_times:array<double>,mean_auc:double,"
        "std_auc:double,mean_fit_time:double,total_fit_time:double>>"
    )
    return (
        spark.read.option("multiLine", True).schema(schema).json(path)
        .select(F.explode("results").alias("r"))
        .select("r.*")
        .withColumn("params", F.transform_values("params", _one_line))
    )


def _one_line(_: Column, value: Column) -> Column:
    return F.when(value.startswith("["), F.regexp_replace(value, r"\s+", "")).otherwise(value)


def read_history_json(spark: SparkSession, path: str) -> DataFrame:
    """Per-round history stored as parallel arrays, one row per round."""
    if not path_exists(spark, path):
        raise FileNotFoundError(path)
    schema = ("epoch array<int>, train_loss array<double>, val_loss array<double>,"
              "train_auc array<double>, val_auc array<double>")
    return (
        spark.read.option("multiLine", True).schema(schema).json(path)
        .select(F.explode(F.arrays_zip(
            "epoch", "train_loss", "val_loss", "train_auc", "val_auc")).alias("r"))
        .select("r.*")
    )
