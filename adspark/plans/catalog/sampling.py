"""Sampling queries. They run on ``events``, whose identifier is unique."""

from adspark import operators as op
from adspark.plans.catalog.rounding import rounded
from adspark.plans.catalog.sqltext import IMP
from adspark.plans.impressions import events_as_impressions

SAMPLE = 500


def _rows(spark, sf):
    return events_as_impressions(spark, sf).select("id", "click", "hour")


def stratified_sample(spark, sf):
    return op.stratified_sample(_rows(spark, sf), SAMPLE)


def sample_summary(spark, sf):
    rows = _rows(spark, sf)
    return rounded(op.sample_summary(rows, op.stratified_sample(rows, SAMPLE)))


def row_sample(spark, sf):
    return op.row_sample(_rows(spark, sf), 700)


def class_counts(spark, sf):
    return rounded(op.class_counts(_rows(spark, sf)))


def folds(spark, sf):
    return op.stratified_folds(_rows(spark, sf), 5).select("id", "click", "fold")


def folds_hashed(spark, sf):
    return op.stratified_folds(_rows(spark, sf), 5, exact=False).select("id", "fold")


def fold_balance(spark, sf):
    from pyspark.sql import functions as F
    return op.stratified_folds(_rows(spark, sf), 5).groupBy("fold").agg(
        F.count("*").alias("n"), F.sum("click").alias("clicks"))


def train_valid_split(spark, sf):
    return op.train_valid_split(_rows(spark, sf)).select("id", "part")


def sample_null_ids(spark, sf):
    """Class sizes of an exact sample where every tenth identifier is missing."""
    from pyspark.sql import functions as F
    rows = _rows(spark, sf).withColumn("id", F.when(F.col("id") % 10 != 0, F.col("id")))
    return op.stratified_sample(rows, SAMPLE).groupBy("click").agg(F.count("*").alias("n"))


def sample_many_strata(spark, sf):
    """An exact sample of orders within every customer."""
    orders = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_custkey")
    return op.stratified_sample(orders, orders.count() // 2, target="o_custkey",
                                id_column="o_orderkey")


_KEY = "md5(concat(CAST(id AS VARCHAR), '42'))"
_RANKED = f"""
WITH {IMP}, k AS (
  SELECT id, click, hour, row_number() OVER (PARTITION BY click ORDER BY {_KEY}) AS rn,
         COUNT(*) OVER (PARTITION BY click) AS cnt, COUNT(*) OVER () AS total
  FROM imp),
drawn AS (
  SELECT id, click, hour FROM k
  WHERE rn <= greatest(1, round_even({SAMPLE}::DOUBLE * cnt / total, 0)))
"""

QUERIES = {
    "stratified_sample": stratified_sample,
    "sample_summary": sample_summary,
    "row_sample": row_sample,
    "class_counts": class_counts,
    "folds": folds,
    "folds_hashed": folds_hashed,
    "fold_balance": fold_balance,
    "train_valid_split": train_valid_split,
    "sample_null_ids": sample_null_ids,
    "sample_many_strata": sample_many_strata,
}

ORACLE = {
    "stratified_sample": _RANKED + "SELECT id, click, hour FROM drawn",
    "sample_summary": _RANKED + """
      SELECT 'Original' AS set, COUNT(*) AS records, round(AVG(click), 6) AS rate,
             CAST(NULL AS DOUBLE) AS delta FROM imp
      UNION ALL
      SELECT 'Sample', COUNT(*), round(AVG(click), 6),
             round(AVG(click) - (SELECT AVG(click) FROM imp), 6) FROM drawn""",
    "row_sample": f"WITH {IMP} SELECT id, click, hour FROM imp ORDER BY {_KEY} LIMIT 700",
    "class_counts": f"""WITH {IMP}
      SELECT click AS target, COUNT(*) AS n,
             round(COUNT(*) / SUM(COUNT(*)) OVER (), 6) AS proportion
      FROM imp GROUP BY click""",
    "folds": _RANKED + "SELECT id, click, CAST((rn - 1) % 5 AS INTEGER) AS fold FROM k",
    "folds_hashed": f"""WITH {IMP} SELECT id,
      CAST(CAST(concat('0x', substr({_KEY}, 1, 8)) AS BIGINT) % 5 AS INTEGER) AS fold FROM imp""",
    "fold_balance": _RANKED + """
      SELECT CAST((rn - 1) % 5 AS INTEGER) AS fold, COUNT(*) AS n,
             CAST(SUM(click) AS BIGINT) AS clicks FROM k GROUP BY 1""",
    "train_valid_split": _RANKED + """
      SELECT id, CASE WHEN rn <= round_even(0.2 * cnt, 0) THEN 'valid' ELSE 'train' END AS part
      FROM k""",
    "sample_null_ids": _RANKED + f"""
      SELECT click, CAST(greatest(1, round_even({SAMPLE}::DOUBLE * any_value(cnt)
        / any_value(total), 0)) AS BIGINT) AS n FROM k GROUP BY click""",
    "sample_many_strata": """
      WITH k AS (SELECT o_orderkey, o_custkey,
          row_number() OVER (PARTITION BY o_custkey
            ORDER BY md5(concat(CAST(o_orderkey AS VARCHAR), '42'))) AS rn,
          COUNT(*) OVER (PARTITION BY o_custkey) AS cnt, COUNT(*) OVER () AS total FROM orders)
      SELECT o_orderkey, o_custkey FROM k
      WHERE rn <= greatest(1, round_even((total // 2)::DOUBLE * cnt / total, 0))""",
}
