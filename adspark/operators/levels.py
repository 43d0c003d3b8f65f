"""Level counts of many columns in one scan; the base of most profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from adspark._checks import require_columns, require_names, require_positive_int


def checked_target(target: str) -> Column:
    """The target as 0 or 1; an error on other values, null stays null."""
    value = F.col(target).cast("double")
    return F.when(value.isin(0.0, 1.0) | value.isNull(), value.cast("int")).otherwise(
        F.raise_error(F.concat(F.lit("the target must be 0 or 1, not "), value.cast("string")))
        .cast("int"))


def level_counts(df: DataFrame, columns: Sequence[str], target: str | None = None,
                 by: str | None = None) -> DataFrame:
    """``[by,] column, level, n`` and, with a 0/1 ``target``, ``pos``.

    Levels are compared as text and null is a level of its own. Rows with a null
    target are left out; a target other than 0 and 1 is an error. The columns are
    stacked and counted together: one scan, with partial counts before the
    shuffle, so a level that fills a third of the rows is one row per task.
    """
    columns = require_names(list(dict.fromkeys(columns)))
    require_columns(df, [*columns, *([target] if target else []), *([by] if by else [])])
    keep = [F.col(by).alias("_by")] if by else []
    keep += [checked_target(target).alias("_target")] if target else []
    df = df.where(F.col(target).isNotNull()) if target else df
    text = df.select(*keep, *[F.col(c).cast("string").alias(c) for c in columns])
    ids = (["_by"] if by else []) + (["_target"] if target else [])
    stacked = text.unpivot(ids, columns, "column", "level")
    aggs = [F.count("*").alias("n")]
    if target:
        aggs.append(F.sum(F.when(F.col("_target") == 1, 1).otherwise(0)).alias("pos"))
    if not by:
        return stacked.groupBy("column", "level").agg(*aggs)
    return stacked.groupBy(F.col("_by").alias(by), "column", "level").agg(*aggs)


def dominant_levels(counts: DataFrame) -> DataFrame:
    """Most frequent non-null level per column: ``column, level, n``.

    Ties go to the smaller level. An aggregate, not a sort: each task keeps one
    candidate per column.
    """
    best = F.min(F.struct((-F.col("n")).alias("m"), F.col("level").alias("level")))
    return (
        counts.where(F.col("level").isNotNull())
        .groupBy("column").agg(best.alias("b"))
        .select("column", F.col("b.level").alias("level"), (-F.col("b.m")).alias("n"))
    )


def top_levels(counts: DataFrame, k: int | dict[str, int]) -> DataFrame:
    """The ``k`` most frequent non-null levels: ``column, level, n, rank``.

    The rank filter is pushed below the shuffle by Spark (window group limit),
    so a task sends at most ``k`` levels per column.
    """
    per_column = isinstance(k, dict)
    most = require_positive_int(max(k.values()) if per_column else k, "k")
    w = Window.partitionBy("column").orderBy(F.desc("n"), F.asc("level"))
    ranked = (
        counts.where(F.col("level").isNotNull())
        .withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
    )
    if per_column:
        wanted = F.create_map(*[F.lit(x) for kv in k.items() for x in kv])
        ranked = ranked.where(F.col("rank") <= wanted[F.col("column")])
    return ranked.select("column", "level", "n", "rank")


def target_rates(counts: DataFrame, smoothing: float, min_category_size: int = 0) -> DataFrame:
    """Smoothed target rate per level: ``column, level, n, rate``.

    ``(pos + m * mean) / (n + m)`` with ``mean`` the overall rate. A level seen
    fewer than ``min_category_size`` times gets the overall rate. Null is no
    level here: it is looked up as unseen.
    """
    if smoothing < 0:
        raise ValueError("'smoothing' must not be negative")
    mean = overall_rate(counts).scalar()
    m = F.lit(float(smoothing))
    rate = (F.col("pos") + m * mean) / (F.col("n") + m)
    if min_category_size > 0:
        rate = F.when(F.col("n") < min_category_size, mean).otherwise(rate)
    return counts.where(F.col("level").isNotNull()).select("column", "level", "n", rate.alias("rate"))


def overall_rate(counts: DataFrame) -> DataFrame:
    """Overall target rate, one row; every column counts the same rows."""
    return counts.agg((F.sum("pos") / F.sum("n")).alias("rate"))


def keep_top_levels(df: DataFrame, column: str, n: int) -> DataFrame:
    """Rows whose level is among the ``n`` most frequent ones of ``column``.

    The level list has ``n`` rows, which bounds the broadcast.
    """
    require_positive_int(n, "n")
    require_columns(df, [column])
    top = (
        df.groupBy(column).agg(F.count("*").alias("_n"))
        .orderBy(F.desc("_n"), F.asc_nulls_last(column)).limit(n).select(column)
    )
    return df.join(F.broadcast(top), column, "left_semi")
