"""Rank correlation of numeric columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from adspark import config
from adspark._checks import require_choice, require_columns, require_names
from adspark.operators.lookup import lookup_join
from adspark.operators.prefix import cut_points, running_totals
from adspark.sources.scratch import materialize, release


def _counted_ranks(stacked: DataFrame, ties: str) -> DataFrame:
    """Ranks of the values in ``column, value, n`` rows, which may repeat a value."""
    counts = materialize(
        stacked.groupBy("column", "value").agg(F.sum("n").alias("n")), "values")
    placed = running_totals(
        counts, "value", ["n"], cut_points(counts, "value"), by=["column"])
    shift = F.lit(1.0) if ties == "min" else (F.col("n") + 1) / 2.0
    ranks = materialize(
        placed.select("column", "value", "n", (F.col("n_below") + shift).alias("rank")),
        "ranks", sort_by=("column",))
    release(counts)
    return ranks


def value_ranks(df: DataFrame, columns: Sequence[str], ties: str = "min") -> DataFrame:
    """Rank of every distinct value: ``column, value, n, rank``, a written table.

    Nulls are ranked, last. ``ties="min"`` gives equal values their smallest
    rank, ``"average"`` their mean rank.
    """
    columns = require_names(columns)
    require_choice(ties, "ties", ("min", "average"))
    require_columns(df, columns)
    stacked = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        [], columns, "column", "value")
    return _counted_ranks(stacked.withColumn("n", F.lit(1).cast("long")), ties)


def rank_correlation(
    df: DataFrame,
    columns: Sequence[str] = (*config.NUMERIC, *config.SCALED),
    ties: str = "min",
    spread_by: Sequence[str] | None = None,
) -> DataFrame:
    """Correlation of ranks for every pair: ``col_i, col_j, rho``, lower triangle.

    The rows are read once and reduced to their distinct value tuples with counts, written.
    Ranks come from the tuples and are looked up by them, and the correlations are weighted
    moments about the mean rank of each column, which the rank table gives.
    ``spread_by`` is not needed any more: tuples tell themselves apart.
    """
    columns = require_names(list(columns))
    require_choice(ties, "ties", ("min", "average"))
    require_columns(df, columns)
    tuples = materialize(
        df.groupBy(*[F.col(c).cast("double").alias(c) for c in columns])
        .agg(F.count("*").alias("_n")), "tuples")
    ranks = _counted_ranks(
        tuples.unpivot(["_n"], columns, "column", "value").withColumnRenamed("_n", "n"), ties)
    known = {r["column"]: r for r in ranks.groupBy("column").agg(
        F.count("*").alias("values"), (F.sum(F.col("n") * F.col("rank")) / F.sum("n")).alias("mean"),
    ).collect()}
    rows = tuples
    for i, c in enumerate(columns):
        one = ranks.where(F.col("column") == c).select(
            F.col("value").alias(c), "n", F.col("rank").alias(f"_r{i}"))
        bytes_of = known[c]["values"] * 56 if c in known else 0
        rows = lookup_join(rows, one, c, [f"_r{i}"], columns, null_matches=True, stored=True,
                           dim_bytes=bytes_of)
    off = [F.col(f"_r{i}") - F.lit(known[c]["mean"] if c in known else 0.0)
           for i, c in enumerate(columns)]
    pairs = [(i, j) for i in range(len(columns)) for j in range(i + 1)]
    sums = rows.agg(*[F.sum(F.col("_n") * off[i] * off[j]).alias(f"c{i}_{j}") for i, j in pairs])
    cells = F.array(*[
        F.struct(F.lit(columns[i]).alias("col_i"), F.lit(columns[j]).alias("col_j"),
                 (F.col(f"c{i}_{j}") / F.nullif(
                     F.sqrt(F.col(f"c{i}_{i}")) * F.sqrt(F.col(f"c{j}_{j}")), F.lit(0.0))
                  ).alias("rho"))
        for i, j in pairs
    ])
    return sums.select(F.explode(cells).alias("r")).select("r.*")
