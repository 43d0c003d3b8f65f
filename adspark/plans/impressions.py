"""The star-schema test tables seen as impressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from adspark.functions import hour_code

# device_id of the placeholder device in this view
PLACEHOLDER = 0
CATEGORIES = ("c_mktsegment", "n_name", "r_name")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_as_impressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One impression per event, without customer attributes."""
    k = F.get_json_object("props", "$.k")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        (F.col("event_type") == "click").cast("int").alias("click"),
        hour_code("ts").alias("hour"),
        F.col("user_id").alias("device_id"),
        k.alias("device_ip"),
        (F.col("value") / 500.0).alias("score_a"),
        (k.cast("double") / 100.0).alias("score_b"),
    )


def impressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Impressions with the customer's segment, nation and region.

    ``nation`` and ``region`` have a fixed number of rows (25 and 5), which
    bounds the two broadcasts; how to join ``customer`` is left to Spark.
    """
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    region = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    place = nation.join(
        F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))
    customer = table(spark, sf_dir, "customer").select(
        "c_custkey", "c_mktsegment", "c_nationkey")
    who = customer.join(F.broadcast(place), F.col("c_nationkey") == F.col("n_nationkey"))
    return events_as_impressions(spark, sf_dir).join(
        who, F.col("device_id") == F.col("c_custkey"),
    ).select("id", "click", "hour", "device_id", "device_ip", *CATEGORIES,
             "score_a", "score_b")


def sold_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with part and order attributes; target: the line was returned."""
    part = table(spark, sf_dir, "part")
    orders = table(spark, sf_dir, "orders")
    return (
        table(spark, sf_dir, "lineitem")
        .join(part, F.col("l_partkey") == F.col("p_partkey"), "left")
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left")
        .withColumn("returned", (F.col("l_returnflag") == "R").cast("int"))
    )


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents: concentrated categories and a rare target."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return docs.join(table(spark, sf_dir, "labels"), "doc_id")
