"""Stored summaries of levels that merge without another scan.

A summary row stands for one group (a day, say) and one column: how many rows,
how many nulls, a sketch of the distinct levels and one of the frequent ones, all
of fixed size. Groups are summarized once, when their rows arrive, and kept in a
folder per group; any set of them merges from the summaries alone. What the
sketches find is then made exact where it has to be: ``frequent_levels`` counts the
candidates again and proves that no other level can be among the first.

Levels are compared as text. Null is no level; it is counted apart.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from adspark._checks import require_columns, require_names, require_positive_int
from adspark.operators.levels import level_counts, top_levels
from adspark.sources.scratch import materialize, release

LOG2_SIZE, TRACKED = 12, 1024
#: Three standard errors of a merged sketch of ``2**LOG2_SIZE`` registers, as a share.
DISTINCT_ERROR = 3 * 1.04 / 2 ** (LOG2_SIZE / 2)


def summarize_levels(df: DataFrame, columns: Sequence[str], by: str,
                     log2_size: int = LOG2_SIZE, tracked: int = TRACKED) -> DataFrame:
    """``by, column, n, n_null, distinct, frequent``: a row per group and column, one scan.

    Tasks shuffle a sketch per group and column, however many levels there are.
    """
    columns = require_names(list(dict.fromkeys(columns)))
    require_columns(df, [*columns, by])
    require_positive_int(tracked, "tracked")
    text = df.select(F.col(by).alias("_by"), *[F.col(c).cast("string").alias(c) for c in columns])
    return text.unpivot(["_by"], columns, "column", "level").groupBy(
        F.col("_by").alias(by), "column").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("level").isNull()).alias("n_null"),
        F.hll_sketch_agg("level", F.lit(log2_size)).alias("distinct"),
        F.expr(f"approx_top_k_accumulate(level, {tracked}) FILTER (WHERE level IS NOT NULL)")
        .alias("frequent"))


def write_summaries(summaries: DataFrame, path: str, by: str) -> None:
    """Store summaries in a folder per group; groups that are there already are replaced, others stay."""
    (summaries.repartition(by).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path))


def read_summaries(spark: SparkSession, path: str) -> DataFrame:
    """The stored summaries of all groups; a filter on the group reads its folders alone."""
    return spark.read.parquet(path)


def merge_summaries(summaries: DataFrame, tracked: int = TRACKED) -> DataFrame:
    """``column, n, n_null, distinct, frequent`` of all groups together."""
    return summaries.groupBy("column").agg(
        F.sum("n").alias("n"), F.sum("n_null").alias("n_null"),
        F.hll_union_agg("distinct").alias("distinct"),
        F.expr(f"approx_top_k_combine(frequent, {tracked})").alias("frequent"))


def summary_cardinality(summaries: DataFrame, tracked: int = TRACKED) -> DataFrame:
    """``column, n, n_null, n_distinct``, the last an estimate within ``DISTINCT_ERROR``, mostly."""
    return merge_summaries(summaries, tracked).select(
        "column", "n", "n_null", F.hll_sketch_estimate("distinct").alias("n_distinct"))


def candidate_levels(summaries: DataFrame, tracked: int = TRACKED) -> DataFrame:
    """``column, level, bound``: up to ``tracked`` levels a column; no other one has over ``bound`` rows.

    A sketch of ``tracked`` levels errs by less than ``2.625 / tracked`` of its rows
    (3.5 over its slots, of which three quarters are used). A level that it does not list is either
    not held, or held with a lower bound below that error, so it has at most twice as many
    rows; or the list is full, and it has no more than the last level on it.
    """
    merged = merge_summaries(summaries, tracked).select(
        "column", (F.col("n") - F.col("n_null")).alias("n"),
        F.expr(f"approx_top_k_estimate(frequent, {tracked})").alias("found"))
    least = F.when(F.size("found") >= tracked, F.array_min(F.transform(
        "found", lambda x: x["count"]))).otherwise(F.lit(0))
    bound = F.greatest(F.floor(F.col("n") * F.lit(5.25 / tracked)), least)
    return merged.select("column", bound.alias("bound"), F.explode_outer("found").alias("x")).select(
        "column", F.col("x.item").alias("level"), "bound")


def frequent_levels(df: DataFrame, summaries: DataFrame, k: int, tracked: int = TRACKED) -> DataFrame:
    """The exact ``k`` most frequent levels of the columns summarized: ``column, level, n, rank``.

    ``summaries`` must be of the rows of ``df``. Candidates, at most ``tracked`` a column, are
    broadcast and counted in one scan that shuffles no other level. A column is settled when
    its k-th candidate has more rows than any level that is no candidate can have, or when the
    candidates are all its levels. Columns that are not (levels spread evenly, say) are
    counted in full.
    """
    require_positive_int(k, "k")
    if k > tracked:
        raise ValueError("'k' must not exceed 'tracked'")
    candidates = materialize(candidate_levels(summaries, tracked), "candidates")
    sizes = summaries.groupBy("column").agg(F.sum(F.col("n") - F.col("n_null")).alias("all"))
    columns = [r["column"] for r in sizes.select("column").collect()]
    if not columns:
        return top_levels(level_counts(df, df.columns[:1]).limit(0), k)
    text = df.select(*[F.col(c).cast("string").alias(c) for c in columns])
    counts = materialize(
        text.unpivot([], columns, "column", "level")
        .join(F.broadcast(candidates.select("column", "level")), ["column", "level"])
        .groupBy("column", "level").agg(F.count("*").alias("n")), "candidate-counts")
    top = top_levels(counts, k)
    last = top.groupBy("column").agg(F.min("n").alias("last"), F.count("*").alias("listed"))
    covered = counts.groupBy("column").agg(F.sum("n").alias("covered"))
    bound = candidates.groupBy("column").agg(F.max("bound").alias("bound"))
    proven = (F.col("covered") == F.col("all")) | (
        (F.col("listed") == k) & (F.col("last") > F.col("bound")))
    checked = (sizes.join(bound, "column", "left").join(covered, "column", "left")
               .join(last, "column", "left").fillna(0))
    # a name per column
    open_ = [r["column"] for r in checked.filter(~proven).select("column").collect()]
    release(candidates)
    if not open_:
        return top
    return top.filter(~F.col("column").isin(open_)).unionByName(
        top_levels(level_counts(df, open_), k))
