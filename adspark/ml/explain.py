"""Local explanations of single predictions.

The method is that of Ribeiro, Singh and Guestrin (2016): perturb a case, score
the perturbed rows, fit a weighted linear model to which features kept the
case's value. Many cases are explained in one job.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, Window, functions as F

from adspark._checks import require_columns, require_positive_int
from adspark.ml.train import positive_probability
from adspark.operators.levels import level_counts

QUARTILES = [0.25, 0.5, 0.75]
SELECT_PENALTY = 0.01
FIT_PENALTY = 1.0
#: Hex digits of a level's hash bucket, and the draws (of all columns) up to which they are broadcast.
BUCKET_DIGITS = 3
BROADCAST_DRAWS = 1_000_000


def quartile_edges(df: DataFrame, numeric: Sequence[str]) -> dict[str, list[float]]:
    """Distinct quartiles of every numeric column, three numbers at most each."""
    if not numeric:
        return {}
    found = df.select(*[F.col(c).cast("double").alias(c) for c in numeric]).approxQuantile(
        list(numeric), QUARTILES, 0.001)
    return {c: sorted(set(q)) for c, q in zip(numeric, found)}


def quartile_bin(value: Column, edges: Sequence[float]) -> Column:
    """Number of edges below the value."""
    out = F.lit(0)
    for e in edges:
        out = out + F.when(value > F.lit(float(e)), 1).otherwise(0)
    return out


def _bin_text(column: str, value: Column, edges: Sequence[float]) -> Column:
    if not edges:
        return F.lit(column)
    shown = [f"{e:.2f}" for e in edges]
    out = F.when(value <= F.lit(float(edges[0])), f"{column} <= {shown[0]}")
    for i in range(1, len(edges)):
        out = out.when(value <= F.lit(float(edges[i])), f"{shown[i - 1]} < {column} <= {shown[i]}")
    return out.otherwise(f"{column} > {shown[-1]}")


def value_pool(reference: DataFrame, columns: Sequence[str], draws: int,
               seed: int = 42) -> DataFrame:
    """``draw, <columns>``: independent draws from each column's distribution.

    A draw is a row position, a hash of column, draw and seed; its value is the level that
    holds the position when equal levels stand together, ordered by their md5. So levels
    appear with their frequencies, null among them, and the columns are unrelated to each
    other. The reference is read by one count of its levels; positions are looked up in
    running counts, of up to 4,096 hash buckets per column and then inside a bucket.
    Values are text. ``draws`` is the number of rows, none where the reference is empty.
    """
    require_positive_int(draws, "draws")
    known = F.concat(F.lit("="), F.col("level"))
    counts = level_counts(reference, columns).withColumn(
        "_key", F.md5(F.coalesce(known, F.lit("null")))).withColumn(
        "_p", F.substring("_key", 1, BUCKET_DIGITS))
    # at most 4,096 buckets a column
    groups = Window.partitionBy("column")
    buckets = counts.groupBy("column", "_p").agg(F.sum("n").alias("_m")).select(
        "column", "_p", F.sum("_m").over(groups).alias("_rows"),
        (F.sum("_m").over(groups.orderBy("_p")) - F.col("_m")).alias("_start"))

    digits = F.substring(F.md5(F.concat_ws("|", "column", "_draw", F.lit(str(seed)))), 1, 12)
    share = F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 48))
    places = buckets.groupBy("column").agg(F.max("_rows").alias("_rows")).withColumn(
        "_draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).select(
        "column", "_draw", F.floor(share * F.col("_rows")).alias("_at"))
    # buckets and draws of a column, by position: the bucket before a draw holds it
    none = F.lit(None)
    line = buckets.select(
        "column", F.col("_start").alias("_at"), "_p", "_start", none.cast("int").alias("_draw")
    ).unionByName(places.withColumns({"_p": none.cast("string"), "_start": none.cast("long")}))
    before = groups.orderBy("_at", F.asc_nulls_first("_draw")).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    placed = line.withColumns({
        c: F.last(c, ignorenulls=True).over(before) for c in ("_p", "_start")}).where(
        F.col("_draw").isNotNull()).select(
        F.col("column").alias("_c"), F.col("_p").alias("_q"), "_draw",
        (F.col("_at") - F.col("_start")).alias("_left"))
    if draws * len(columns) <= BROADCAST_DRAWS:
        placed = F.broadcast(placed)

    upto = Window.partitionBy("column", "_p").orderBy("_key", "level")
    levels = counts.withColumn("_end", F.sum("n").over(upto))
    found = levels.join(placed, (F.col("column") == F.col("_c")) & (F.col("_p") == F.col("_q"))
                        & (F.col("_left") < F.col("_end"))
                        & (F.col("_left") >= F.col("_end") - F.col("n")))
    return found.groupBy(F.col("_draw").alias("draw")).pivot("column", list(columns)).agg(
        F.first("level"))


def _ridge(x: np.ndarray, y: np.ndarray, w: np.ndarray, penalty: float):
    total = w.sum()
    mx, my = (w[:, None] * x).sum(0) / total, (w * y).sum() / total
    xc, yc = x - mx, y - my
    gram = (xc * w[:, None]).T @ xc + penalty * np.eye(x.shape[1])
    beta = np.linalg.solve(gram, (xc * w[:, None]).T @ yc)
    return beta, my - mx @ beta


def _surrogate(names: list[str], num_features: int, kernel_width: float):
    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("draw")
        x = np.stack(rows["kept"].to_numpy()).astype(float)
        y = rows["score"].to_numpy(dtype=float)
        distance2 = (1.0 - x).sum(axis=1)
        w = np.sqrt(np.exp(-distance2 / kernel_width ** 2))
        first, _ = _ridge(x, y, w, SELECT_PENALTY)
        chosen = np.argsort(-np.abs(first), kind="stable")[:num_features]
        beta, intercept = _ridge(x[:, chosen], y, w, FIT_PENALTY)
        fitted = x[:, chosen] @ beta + intercept
        mean = (w * y).sum() / w.sum()
        spread = (w * (y - mean) ** 2).sum()
        r2 = 1.0 - (w * (y - fitted) ** 2).sum() / spread if spread > 0 else 0.0
        order = np.argsort(-np.abs(beta), kind="stable")
        return pd.DataFrame({
            "case_id": rows["case_id"].iloc[0],
            "rank": np.arange(1, len(order) + 1, dtype="int32"),
            "feature": [names[chosen[i]] for i in order],
            "weight": beta[order], "intercept": intercept, "r2": r2,
            "case_score": y[0],
        })
    return fit


def explain(
    model: PipelineModel,
    cases: DataFrame,
    reference: DataFrame,
    categorical: Sequence[str],
    numeric: Sequence[str],
    num_features: int = 10,
    num_samples: int = 5000,
    id_column: str = "id",
    seed: int = 42,
) -> DataFrame:
    """Signed feature weights of each case.

    ``case_id, rank, feature, condition, weight, intercept, r2, case_score``;
    positive weights speak for class 1. Each case becomes ``num_samples`` rows:
    itself and rows of drawn values. A feature counts as kept when a drawn level
    equals the case's, or a drawn number falls into the case's quartile range.
    One case's rows, whose number is a parameter, are fitted in one task.
    """
    require_positive_int(num_features, "num_features")
    require_positive_int(num_samples, "num_samples")
    names = [*categorical, *numeric]
    require_columns(cases, [id_column, *names])
    require_columns(reference, names)
    edges = quartile_edges(reference, numeric)
    types = dict(reference.dtypes)
    pool = value_pool(reference, names, max(1, num_samples - 1), seed)

    base = cases.select(
        F.col(id_column).cast("string").alias("case_id"),
        *[F.col(c).alias(f"case_{c}") for c in names])
    drawn = base.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(num_samples - 1))))
    drawn = drawn.withColumn("_slot", F.col("draw") - 1)
    # fewer than num_samples pool rows
    rows = drawn.join(
        F.broadcast(pool.withColumnRenamed("draw", "_slot")), "_slot", "left")
    own = F.col("draw") == 0
    rows = rows.select(
        "case_id", "draw", *[F.col(f"case_{c}") for c in names],
        *[F.when(own, F.col(f"case_{c}")).otherwise(F.col(c).cast(types[c])).alias(c)
          for c in names])

    def kept(c: str) -> Column:
        if c in edges:
            a = quartile_bin(F.col(c).cast("double"), edges[c])
            b = quartile_bin(F.col(f"case_{c}").cast("double"), edges[c])
            return (a == b).cast("double")
        return F.col(c).eqNullSafe(F.col(f"case_{c}")).cast("double")

    scored = model.transform(rows).select(
        "case_id", "draw", F.array(*[kept(c) for c in names]).alias("kept"),
        positive_probability().alias("score"))
    weights = scored.groupBy("case_id").applyInPandas(
        _surrogate(names, num_features, 0.75 * math.sqrt(len(names))),
        "case_id string, rank int, feature string, weight double, intercept double, "
        "r2 double, case_score double")

    conditions = base.select("case_id", F.explode(F.array(*[
        F.struct(
            F.lit(c).alias("feature"),
            (_bin_text(c, F.col(f"case_{c}").cast("double"), edges[c]) if c in edges
             else F.concat(F.lit(f"{c}="), F.coalesce(
                 F.col(f"case_{c}").cast("string"), F.lit("null")))).alias("condition"))
        for c in names
    ])).alias("r")).select("case_id", "r.*")
    return weights.join(conditions, ["case_id", "feature"]).select(
        "case_id", "rank", "feature", "condition", "weight", "intercept", "r2", "case_score",
    ).orderBy("case_id", "rank")
