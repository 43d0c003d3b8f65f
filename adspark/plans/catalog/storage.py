"""Sources and sinks: each query writes something made of the tables and reads it back."""

from adspark import operators as op
from adspark.plans.catalog.rounding import rounded
from adspark.plans.catalog.sqltext import IMP, SPLIT, stacked_levels
from adspark.functions import day_of_month
from adspark.ml.search import read_results, summarize_folds, top_results
from adspark.operators.summaries import DISTINCT_ERROR
from adspark.plans.impressions import events_as_impressions, impressions, table
from adspark.sources.gzipped import write_gzip_csv
from adspark.sources.readers import csv_to_parquet, read_split, register_parquet
from adspark.sources.relation import as_df, stack_predictions
from adspark.sources.scratch import new_scratch_path
from adspark.sources.writers import (
    append_results, refresh_subset, subset_written as subset_done, write_predictions,
    write_subsets,
)
from pyspark.sql import functions as F


def csv_converted(spark, sf):
    """Impressions as gzip CSV, converted to Parquet under their schema."""
    rows = events_as_impressions(spark, sf).select("id", "click", "hour", "device_id", "device_ip")
    source, target = new_scratch_path(spark, "csv"), new_scratch_path(spark, "parquet")
    rows.write.option("header", True).option("compression", "gzip").csv(source)
    first = csv_to_parquet(spark, source, target, rows.schema)
    csv_to_parquet(spark, source, target, rows.schema)  # finished: stays as it is
    return first


def csv_members_converted(spark, sf):
    """Impressions as gzip CSV of several members a file, decoded by ranges of bytes."""
    rows = events_as_impressions(spark, sf).select("id", "click", "hour", "device_id", "device_ip")
    source = write_gzip_csv(rows, new_scratch_path(spark, "csv"), 2_000)
    return csv_to_parquet(spark, source, new_scratch_path(spark, "parquet"), rows.schema,
                          gzip_split_bytes=50_000)


def subset_written(spark, sf):
    """The holdout subset out of a table with both."""
    path = new_scratch_path(spark, "subsets")
    write_subsets(op.add_split(events_as_impressions(spark, sf)).select("id", "click", "split"),
                  path)
    return read_split(spark, path, "Prueba")


def subset_refreshed(spark, sf):
    """Both subsets after the holdout one alone was written again, with other clicks."""
    path = new_scratch_path(spark, "subsets")
    rows = op.add_split(events_as_impressions(spark, sf)).select("id", "click", "split")
    write_subsets(rows, path)
    refresh_subset(rows.withColumn("click", F.col("click") + 10), path, "Prueba")
    parts = [read_split(spark, path, label).withColumn("split", F.lit(label))
             for label in ("Entrenamiento", "Prueba") if subset_done(spark, path, label)]
    return parts[0].unionByName(parts[1])


def _fold_rows(spark, sf):
    """Results per segment and nation, as a search yields them per setting and fold."""
    return table(spark, sf, "customer").groupBy(
        F.col("c_mktsegment").alias("signature"), F.col("c_nationkey").cast("int").alias("fold"),
    ).agg(F.avg("c_acctbal").alias("score"), F.count("*").cast("double").alias("seconds")).withColumn(
        "params", F.create_map(F.lit("segment"), F.col("signature")))


def fold_summary(spark, sf):
    """Mean, deviation and times over folds, with the scores in fold order."""
    return rounded(summarize_folds(_fold_rows(spark, sf)).select(
        "signature", "mean_auc", "std_auc", "mean_fit_time", "total_fit_time",
        F.size("fold_scores").alias("folds"), F.col("fold_scores")[0].alias("first_score")))


def results_log(spark, sf):
    """A log with rows appended twice and a last file torn off in the middle of a line."""
    path = new_scratch_path(spark, "log")
    done = summarize_folds(_fold_rows(spark, sf))
    append_results(done.withColumn("mean_auc", F.lit(-1.0)), path, 1)
    append_results(done, path, 3)
    append_results(done.withColumn("mean_auc", F.lit(-2.0)), path, 2)
    torn = done.select(F.to_json(F.struct("signature", "mean_auc")).alias("line")).select(
        F.expr("substring(line, 1, length(line) - 4)").alias("value"))
    torn.write.mode("append").text(path)
    return rounded(read_results(spark, path).select("signature", "mean_auc", "total_fit_time"))


def results_top(spark, sf):
    """The two best rows of the log, a column per parameter."""
    best = top_results(summarize_folds(_fold_rows(spark, sf)), 2)
    return rounded(best.select("segment", "mean_auc", "std_auc"))


def predictions_by_path(spark, sf):
    """Confusion counts of prediction files."""
    rows = impressions(spark, sf)
    folder = new_scratch_path(spark, "predictions")
    paths = {m: write_predictions(
        rows.select("click", F.col(f"score_{m}").alias("prediction")), folder, m)
        for m in ("a", "b")}
    return op.confusion(stack_predictions(spark, paths), 0.5)


SUMMARIZED = ["device_id", "device_ip", "n_name", "c_mktsegment"]


def _daily_summaries(spark, sf):
    """Summaries per day, those of odd days written first, then those of even ones beside them."""
    rows = impressions(spark, sf).withColumn("day", day_of_month("hour"))
    path = new_scratch_path(spark, "summaries")
    for odd in (1, 0):
        part = rows.where(F.col("day") % 2 == odd)
        op.write_summaries(op.summarize_levels(part, SUMMARIZED, "day"), path, "day")
    return op.read_summaries(spark, path)


def merged_cardinality(spark, sf):
    """Rows, nulls and exact levels of columns; whether the merged sketches come near enough."""
    exact = op.cardinality(impressions(spark, sf), SUMMARIZED).withColumnRenamed("n_distinct", "exact")
    near = F.abs(F.col("n_distinct") - F.col("exact")) <= F.col("exact") * DISTINCT_ERROR
    return op.summary_cardinality(_daily_summaries(spark, sf)).join(exact, "column").select(
        "column", "n", "n_null", F.col("exact").alias("n_distinct"), near.alias("within_error"))


def merged_top_levels(spark, sf):
    """The five most frequent levels of columns with few and with many, from merged summaries."""
    return op.frequent_levels(impressions(spark, sf), _daily_summaries(spark, sf), 5)


def relation_text(spark, sf):
    """Levels of a relation given as SQL text over a registered file."""
    register_parquet(spark, f"{sf}/customer.parquet", "stored_customers")
    relation = as_df(spark, "(SELECT c_mktsegment FROM stored_customers WHERE c_acctbal > 0)")
    return rounded(op.level_distribution(relation, "c_mktsegment"))


_FOLDS = """WITH f AS (
  SELECT c_mktsegment AS signature, c_nationkey AS fold, AVG(c_acctbal) AS score,
         COUNT(*)::DOUBLE AS seconds FROM customer GROUP BY 1, 2)
"""

QUERIES = {
    "csv_converted": csv_converted,
    "csv_members_converted": csv_members_converted,
    "subset_written": subset_written,
    "subset_refreshed": subset_refreshed,
    "fold_summary": fold_summary,
    "results_log": results_log,
    "results_top": results_top,
    "predictions_by_path": predictions_by_path,
    "merged_cardinality": merged_cardinality,
    "merged_top_levels": merged_top_levels,
    "relation_text": relation_text,
}

ORACLE = {
    "csv_converted": f"WITH {IMP} SELECT id, click, hour, device_id, device_ip FROM imp",
    "csv_members_converted": f"WITH {IMP} SELECT id, click, hour, device_id, device_ip FROM imp",
    "subset_written": f"""WITH {IMP}, s AS (SELECT id, click, {SPLIT} AS split FROM imp)
      SELECT id, click FROM s WHERE split = 'Prueba'""",
    "subset_refreshed": f"""WITH {IMP}, s AS (SELECT id, click, {SPLIT} AS split FROM imp)
      SELECT id, CASE WHEN split = 'Prueba' THEN click + 10 ELSE click END AS click, split FROM s""",
    "fold_summary": _FOLDS + """SELECT signature, round(AVG(score), 6) AS mean_auc,
        round(stddev_pop(score), 6) AS std_auc, round(AVG(seconds), 6) AS mean_fit_time,
        round(SUM(seconds), 6) AS total_fit_time, COUNT(*)::INTEGER AS folds,
        round(arg_min(score, fold), 6) AS first_score FROM f GROUP BY signature""",
    "results_log": _FOLDS + """SELECT signature, round(AVG(score), 6) AS mean_auc,
        round(SUM(seconds), 6) AS total_fit_time FROM f GROUP BY signature""",
    "results_top": _FOLDS + """SELECT signature AS segment, round(AVG(score), 6) AS mean_auc,
        round(stddev_pop(score), 6) AS std_auc FROM f GROUP BY signature
      ORDER BY AVG(score) DESC LIMIT 2""",
    "predictions_by_path": f"""WITH {IMP}, p AS (
        SELECT 'a' AS model, click, score_a AS x FROM imp
        UNION ALL SELECT 'b', click, score_b FROM imp)
      SELECT model, 0.5::DOUBLE AS threshold, COUNT(*) AS n, COUNT(*) FILTER (click = 1) AS n_pos,
             COUNT(*) FILTER (click = 0) AS n_neg,
             COUNT(*) FILTER (click = 1 AND x >= 0.5) AS tp,
             COUNT(*) FILTER (click = 0 AND x >= 0.5) AS fp,
             COUNT(*) FILTER (click = 1 AND x < 0.5) AS fn,
             COUNT(*) FILTER (click = 0 AND x < 0.5) AS tn
      FROM p GROUP BY model""",
    "merged_cardinality": f"WITH {IMP} " + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", COUNT(*) AS n, COUNT(*) - COUNT({c}) AS n_null, "
        f"COUNT(DISTINCT {c}) AS n_distinct, TRUE AS within_error FROM imp" for c in SUMMARIZED),
    "merged_top_levels": f"""WITH {IMP}, s AS ({stacked_levels("imp", SUMMARIZED, "click")}),
      r AS (SELECT "column", level, n, CAST(row_number() OVER (
              PARTITION BY "column" ORDER BY n DESC, level) AS INTEGER) AS rank
            FROM s WHERE level IS NOT NULL)
      SELECT * FROM r WHERE rank <= 5""",
    "relation_text": """SELECT c_mktsegment AS level, COUNT(*) AS count,
        round(COUNT(*) * 100.0 / SUM(COUNT(*)) OVER (), 6) AS percentage, c_mktsegment AS label
      FROM customer WHERE c_acctbal > 0 GROUP BY c_mktsegment""",
}
