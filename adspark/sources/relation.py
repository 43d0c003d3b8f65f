"""Turning what a caller passes into a DataFrame."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F

from adspark._checks import require_columns

_NAME = re.compile(r"^[A-Za-z_][\w]*(\.[A-Za-z_][\w]*){0,2}$")


def as_df(spark: SparkSession, relation: DataFrame | str) -> DataFrame:
    """A DataFrame as it is, a table or view name, or an inline query.

    Inline queries are written in parentheses, as one would write them in a
    ``FROM`` clause; a bare ``SELECT`` or ``WITH`` is taken too.
    """
    if isinstance(relation, DataFrame):
        return relation
    if not isinstance(relation, str):
        raise TypeError("'relation' must be a DataFrame or a string")
    text = relation.strip()
    if _NAME.match(text):
        return spark.table(text)
    if text.startswith("(") and text.endswith(")"):
        return spark.sql(f"SELECT * FROM {text} AS relation")
    return spark.sql(text)


def as_predictions(
    spark: SparkSession,
    source: DataFrame | str | os.PathLike,
    target: str = "click",
    prediction: str = "prediction",
    id_column: str | None = None,
) -> DataFrame:
    """Columns ``[id,] target, prediction`` out of a Parquet path or a DataFrame."""
    if isinstance(source, DataFrame):
        df = source
    elif isinstance(source, (str, os.PathLike)):
        df = spark.read.parquet(os.fspath(source))
    else:
        raise TypeError("'source' must be a DataFrame or a path")
    wanted = [target, prediction] + ([id_column] if id_column else [])
    require_columns(df, wanted)
    cols = [F.col(id_column).alias("id")] if id_column else []
    return df.select(
        *cols,
        F.col(target).cast("int").alias("target"),
        F.col(prediction).cast("double").alias("prediction"),
    )


def stack_predictions(
    spark: SparkSession,
    sources: Mapping[str, DataFrame | str | os.PathLike],
    target: str = "click",
    prediction: str = "prediction",
) -> DataFrame:
    """All prediction sources in one table, told apart by ``model``."""
    if not sources:
        raise ValueError("'sources' must contain at least one prediction source")
    parts = [
        as_predictions(spark, src, target, prediction)
        .select(F.lit(name).alias("model"), "target", "prediction")
        for name, src in sources.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def stack_scores(df: DataFrame, target: str, scores: Mapping[str, str]) -> DataFrame:
    """The same shape for several score columns of one table, in one scan."""
    require_columns(df, [target, *scores.values()])
    wide = df.select(
        F.col(target).cast("int").alias("target"),
        *[F.col(c).cast("double").alias(m) for m, c in scores.items()],
    )
    return wide.unpivot(["target"], list(scores), "model", "prediction").select(
        "model", "target", "prediction")
