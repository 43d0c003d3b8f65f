"""Scoring a table with a saved model."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from adspark._checks import require_columns, require_number, require_positive_int
from adspark.ml.train import positive_probability
from adspark.operators.evaluate import (
    failure_counts, is_false_negative, is_false_positive,
)
from adspark.operators.sampling import draw_cases, row_sample
from adspark.sources.relation import as_df
from adspark.sources.scratch import path_exists
from adspark.sources.writers import write_predictions


@dataclass
class Scoring:
    """What a scoring run yields."""

    prediction_time: float
    output_path: str
    n_failures: int
    n_fp: int
    n_fn: int
    failing_cases: DataFrame | None


def predict(model: PipelineModel, df: DataFrame, target: str = "click",
            id_column: str = "id") -> DataFrame:
    """``id, click, prediction`` with the double score of class 1."""
    require_columns(df, [target, id_column])
    return model.transform(df).select(
        F.col(id_column).alias("id"), F.col(target).cast("int").alias("click"),
        positive_probability().alias("prediction"))


def predict_and_save(
    spark: SparkSession,
    model_path: str,
    relation: DataFrame | str,
    target: str = "click",
    output_dir: str | None = None,
    n_rows: int | None = None,
    threshold: float = 0.5,
    extract: bool = True,
    cases_per_kind: int = 1,
    id_column: str = "id",
    seed: int = 42,
) -> Scoring:
    """Score all of ``relation``, or a reproducible sample of ``n_rows`` of it.

    Predictions are written next to the model, or to ``output_dir``, under the
    model's name; failures are counted on the written table. With ``extract``
    some false positives and false negatives come back with their raw features.
    """
    if not path_exists(spark, model_path):
        raise FileNotFoundError(model_path)
    if n_rows is not None:
        require_positive_int(n_rows, "n_rows")
    require_number(threshold, "threshold", 0, 1)
    if not isinstance(extract, bool):
        raise TypeError("'extract' must be a boolean")
    model = PipelineModel.load(model_path)
    rows = as_df(spark, relation)
    require_columns(rows, [target, id_column])
    if n_rows is not None:
        rows = row_sample(rows, n_rows, id_column, seed)

    folder, _, name = model_path.rstrip("/").rpartition("/")
    started = time.monotonic()
    path = write_predictions(
        predict(model, rows, target, id_column), output_dir or folder, name)
    seconds = time.monotonic() - started
    scored = spark.read.parquet(path)
    found = failure_counts(scored.select(
        F.lit(name).alias("model"), F.col("click").alias("target"), "prediction"),
        threshold).first()
    if found is None:
        raise ValueError("the sample has no rows")

    cases = None
    if extract:
        kinds = (("false_positive", is_false_positive(threshold), seed),
                 ("false_negative", is_false_negative(threshold), seed + 1))
        picked = [
            draw_cases(scored, condition, cases_per_kind, "id", s).select(
                F.col("id").alias(id_column), "prediction", F.lit(kind).alias("kind"))
            for kind, condition, s in kinds
        ]
        # 2 x cases_per_kind rows
        both = picked[0].unionByName(picked[1])
        cases = rows.join(F.broadcast(both), id_column)
    return Scoring(seconds, path, int(found["n_failures"]), int(found["n_fp"]),
                   int(found["n_fn"]), cases)
